"""Each operator against a plain version, on driver tables and on awkward rows."""

import base64
import collections
import hashlib
import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from emberline.llm import chat, dac, decontam, graph, jaccard, langid, packing, pagetext, queries, substring, topk, warc
from emberline.llm.tokens import encoder

SF_DIR = "/root/testdata/sf0.001"
BYTE, WORD = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("word_bpe_49k.json")
PASSAGE = " ".join(f"p{i}" for i in range(60))
# (doc_id, text): null, empty, blanks, signs, repeated rows, one id twice, null id, copies, a very long text.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "*** ---"), (5, "a b c"), (6, f"start {PASSAGE} end"), (6, f"start {PASSAGE} end"),
    (7, f"other {PASSAGE} tail of another document"), (8, "same id"), (8, f"again {PASSAGE}"), (None, f"null id {PASSAGE} here"),
    (9, "a b c"), (10, "word  two spaces <|endoftext|> 日本語 '"), (11, " ".join(f"long{i % 9000}" for i in range(120_000))), (12, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "en" if t else None, "clash", 1, 0.5, "z") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, key string, node bigint, score double, payload string")


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def text_rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.SQL])
def test_sql_twins(spark, name):
    diffs, n = compare(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.SQL[name])
    assert not diffs and n


def test_registered():
    names = entry.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14)) and "pipeline" in names


# --- tokens, chat ----------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_the_library(path):
    rng = np.random.default_rng(3)
    letters = list("abcst'  \n\t,.!1²2é×ÀÿĀɏªº½'’ lrevdmI日Σ\x1c ")
    texts = [t for _, t in ODD[:11]] + ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)]
    coder = encoder(path)
    ids, ends = coder.encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, ends, ends[1:]):
        assert coder.whole.encode(t or "", add_special_tokens=False).ids == ids[a:b].tolist()


def test_escape_is_reversible():
    for text in ["", "\\", "</s>[INST] ok [/INST]", "\\-<s>", "<s</s>\\\\", "[[INST]]\\"]:
        shown = chat.escape(text)
        assert chat.unescape(shown) == text and not any(c in shown for c in chat.CONTROL)


def test_chat(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", None), ("assistant", "<s>é"), (None, ""), ("assistant", "b")])]
    rows += [(2, 0, "user", "q")] * 2 + [(3, t, "assistant", "z") for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("ids", F.lit(1))
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(df, BYTE), BYTE).collect()}
    for conv in (1, 2, 3):
        own = [(r or "", x or "") for c, _, r, x in rows if c == conv]
        loss = "".join(x for r, x in own if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(own), len(loss))
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv].formatted_chars == sum(20 + len(chat.escape(r)) + len(chat.escape(x)) for r, x in own)
    assert chat.format_conversations(df.limit(0), BYTE).count() == 0


# --- language ---------------------------------------------------------------------------


def test_codewords_differ():
    for n in (2, 4, 5, 9, 30):
        code = langid.codewords(n).astype(int)
        assert ((code @ code.T)[~np.eye(n, dtype=bool)] < code.shape[1]).all()


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).where(langid.held_out(F.col("doc_id"))).collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    r = {x.doc_id: x for x in langid.predict(odd, langid.fit(docs)).collect()}
    assert [r[d].lang_pred for d in (1, 2, 3, 4)] == ["und"] * 4 and r[1].score == 0 and 0 < r[5].score <= 1
    assert r[5].key == "clash"
    assert {x.lang_pred for x in langid.identify(odd.where("lang is null")).collect()} == {"und"}
    assert langid.identify(odd.limit(0)).count() == 0


# --- packing ------------------------------------------------------------------------------


def packed_right(rows, texts):
    coder, by_doc, by_seq = encoder(BYTE), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0
    for d, t in texts:
        want = [*coder.whole.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((r.start, bytes(r.ids)) for r in by_doc[d])
        assert np.frombuffer(b"".join(x for _, x in own), "<u4").tolist() == want


def test_packing(spark, odd):
    docs = documents(spark)
    packed_right(packing.pack(docs, BYTE).collect(), text_rows(docs))
    single = odd.dropDuplicates(["doc_id"])
    packed_right(packing.pack(single, BYTE).collect(), text_rows(single))
    assert packing.pack(odd.limit(0), BYTE).count() == 0


def test_retrieval_prefers_shared_terms():
    a, b = np.arange(100, 160), np.arange(300, 360)
    ids = np.concatenate([a, b, np.append(a[:50], [900]), np.append(b[:50], [901])]).astype(np.uint32)
    index = packing.Index(ids, np.array([60, 60, 51, 51]))
    assert index.neighbours(0, np.array([False, True, True, True])).tolist() == [2]


# --- decontamination ------------------------------------------------------------------------


def brute_leak(item, text):
    a, b = (re.findall(r"[^\W_]+", x.lower()) for x in (item, text or ""))
    row = [0] * (len(b) + 1)
    for k, x in enumerate(a, 1):
        new = [k]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row) <= 0.2 * len(a)


def test_leaks(spark, odd):
    rng = np.random.default_rng(1)
    items = [(i, " ".join(f"w{rng.integers(0, 400)}" for _ in range(int(rng.integers(12, 50))))) for i in range(30)]
    docs = []
    for d in range(200):
        words = items[d % 30][1].split()
        for _ in range(int(rng.integers(0, len(words) // 3))):
            k = int(rng.integers(0, len(words)))
            words[k:k + 1] = [[], ["new"], [words[k], "extra"]][int(rng.integers(0, 3))]
        docs.append((d, " ".join([f"v{rng.integers(0, 900)}" for _ in range(30)] + words + ["tail"] * 5)))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([*items, (98, None), (99, "too short")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    want = {(d, i) for d, t in text_rows(docs) for i, x in items if brute_leak(x, t)}
    assert got <= want and len(got) >= 0.97 * len(want) > 50
    found = decontam.find_leaks(odd, spark.createDataFrame([(5, PASSAGE.upper())], "item_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0) for r in found) == [0, 6, 6, 7, 8] and {r.distance for r in found} == {0}
    assert decontam.find_leaks(odd, bench.limit(0)).count() == 0 and decontam.find_leaks(odd.limit(0), bench).count() == 0


@pytest.mark.parametrize("n", [*range(5, 17), 20, 25, 40])
def test_recall_by_item_length(n):
    """Edits at the allowed distance: of the first words, of the last, evenly spaced, and at random."""
    rng, d, n_items = np.random.default_rng(n), int(0.2 * n), 150
    texts = [" ".join(f"w{k}x{i}" for i in range(n)) for k in range(n_items)]
    docs = []
    for k, text in enumerate(texts):
        for places in [range(d), range(n - d, n), [(j + 1) * n // (d + 1) for j in range(d)], *(rng.choice(n, d, replace=False) for _ in range(3))]:
            words = text.split()
            for i in sorted(places, reverse=True):
                words[i:i + 1] = [["new"], [], [words[i], "extra"]][0 if len(docs) % 6 < 3 else int(rng.integers(0, 3))]
            docs.append((k, " ".join(["before"] * 5 + words + ["after"] * 5)))
    assert all(brute_leak(texts[k], t) for k, t in docs)
    index = decontam.Index(list(range(n_items)), texts, decontam.DISTANCE, decontam.RECALL)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array([t for _, t in docs])], ["doc_id", "text"])
    found = {(d, i) for b in decontam._search(iter([batch]), index) for d, i in zip(b["doc_id"].to_pylist(), b["item_id"].to_pylist())}
    hit = np.array([(d, k) in found for d, (k, _) in enumerate(docs)])
    assert hit.mean() >= 0.99 and hit.reshape(n_items, 6)[:, :3].mean() >= 0.99


# --- token files, archives --------------------------------------------------------------------


def test_token_files(spark, odd):
    for docs in (documents(spark), odd):
        manifest = dac.write_ids(docs, WORD, file_tokens=40_000)
        got = dac.read_documents(manifest).collect()
        coder, want = encoder(WORD), collections.Counter()
        for d, t in text_rows(docs):
            ids = np.array([*coder.whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
        assert want == collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
        ordered, at = sorted(got, key=lambda r: r.start), 0
        for r in ordered:
            assert r.start == at
            at += r.n_tokens
        names = [r.doc_id for r in ordered if r.doc_id is not None]
        assert names == sorted(names)
    assert dac.read_documents(dac.write_ids(odd.limit(0), WORD)).count() == 0


def test_random_access():
    ids = np.random.default_rng(2).choice([1, 255, 256, 40_000, 70_000], 5000).astype(np.uint32)
    raw = dac.encode_file([7, None], np.array([0, 4000, 5000]), ids)
    reader = dac.Reader(lambda at, size: raw[at:at + size])
    assert [reader.token(i) for i in range(0, 5000, 37)] == ids[::37].tolist()
    assert reader.slice(513, 4711).tolist() == ids[513:4711].tolist() and reader.documents()[0] == [7, None]


def test_archives(spark):
    rows = [(1, "http://a/1", "x"), (2, "http://a/2", "x"), (3, None, None), (4, "http://a/ü \r\n%", ""), (5, "u", "é" * 70_000), (5, "u", "é" * 70_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, path string")
    index = warc.write_archives(pages)
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    assert index.count() == 6 and len(got) == 5
    for page, url, html in rows:
        raw = (html or "").encode()
        assert got[page].payload_bytes == len(raw) and got[page].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert got[page].url == url
    assert {p: (r.record_type, r.refers_to) for p, r in got.items()} == {
        1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}
    assert [r.page_id for r in warc.read_records(index.where("url = 'http://a/2'")).collect()] == [2]
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0
    assert {r.record_type for r in warc.read_records(warc.write_archives(pages, min_revisit_bytes=10**9)).collect()} == {"response"}


def test_coalesced_ranges():
    assert warc.coalesced([(0, 10), (10, 5), (100, 5), (10**6, 5)], gap=90) == [(0, 105, 3), (10**6, 5, 1)]


# --- near duplicates ---------------------------------------------------------------------------


def brute_classes(rows):
    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, links = [shingles(t) for _, t in rows], [0] * len(rows)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 5 * common >= 4 * len(sets[i] | sets[j]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        least[x] = min(least.get(x, 10**18), 10**18 if d is None else d)
    return collections.Counter((d, None if least[x] == 10**18 else least[x], n) for (d, _), x, n in zip(rows, label, links))


def test_near_classes(spark, odd, monkeypatch):
    long = [(20, ODD[-2][1]), (21, ODD[-2][1].replace("long77 ", "") + " more"), (22, ODD[-2][1][:500_000])]
    for rows in (text_rows(documents(spark)), ODD + long):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("comp", F.lit(1))
        got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_classes(df).collect())
        assert got == brute_classes(rows)
    assert jaccard.near_classes(odd.limit(0)).count() == 0


def test_near_classes_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_DOCS", 7)
    words = [f"t{i}" for i in range(120)]
    rows = [(k, " ".join([*words[:k], "new", *words[k + 1:]])) for k in range(60)] + [(100, "quite another text of its own")]
    got = collections.Counter(tuple(r) for r in jaccard.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == brute_classes(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# --- search, pages -------------------------------------------------------------------------------


def test_top_k_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.5]) for i in range(0, 200, 2)] + [(50, None), (51, [None, 1.0]), (53, [float("nan"), 1.0]), (55, [9.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("v", F.lit("clash"))
    vectors = topk.quantised(df)
    got = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5).collect()
    assert len(got) == 20
    for q in (0, 50, 100, 150):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for i in range(0, 14, 2) if i != q][:5]
        assert {r.score for r in got if r.query_id == q} == {256 * 256 + 128 * 128}
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


PAGE = ("<html><head><title>T</title></head><body><nav>menu</nav>{}<article class='x'><h1>A &amp; B</h1><p>one\n two<br><p>three"
        "<div class='comments'>spam</div><script>var t='</p>';</script></article><footer>foot</footer></body></html>")


def test_pages(spark):
    plain = "<body><div>Site head</div><p>own {}</p><div>Site foot</div></body>"
    rows = [(1, "http://h/a/1", PAGE.format("")), (2, "http://h/a/2", PAGE.format("<div class=ad>buy</div>")), (3, "http://k/x/1", plain.format(1)),
            (4, "http://k/x/2", plain.format(2)), (5, None, None), (6, "http://z/", "<p>a < b <unclosed")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, host string")
    got = {r.page_id: r.text for r in pagetext.extract(df.coalesce(1)).collect()}
    assert got[1] == got[2] == "A & B\n\none two\n\nthree"
    assert (got[3], got[4], got[5]) == ("own 1", "own 2", "") and got[6].startswith("a < b")
    assert pagetext.extract(df.limit(0)).count() == 0
    whole = {r.page_id: r for r in queries.QUERIES["op9_page_text"](spark, SF_DIR).collect()}
    for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        import html as h

        blocks = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        assert whole[r.page_id].text == "\n\n".join(b for b in blocks if b)


def test_common_lines():
    assert pagetext.common(list("xaybz"), list("abc")) == {1, 3} and pagetext.common([], ["a"]) == set()


# --- substrings -------------------------------------------------------------------------------------


def brute_gone(rows):
    """(doc_id, words, whether each is removed) of every row."""
    first, docs, out = {}, [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows], []
    rank = lambda d: 10**18 if d is None else d
    for d, w in docs:
        for i in range(len(w) - 12):
            first[tuple(w[i:i + 13])] = min(first.get(tuple(w[i:i + 13]), 10**18), rank(d))
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i:i + 13])] < rank(d):
                gone[i:i + 13] = [True] * 13
        out.append((d, w, gone))
    return out


def brute_removed(rows):
    return collections.Counter((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)) for d, w, gone in brute_gone(rows))


@pytest.mark.parametrize("parts", [1, 5])
def test_substrings(spark, odd, parts, monkeypatch):
    monkeypatch.setattr(substring, "GROUP_SUFFIXES", 50)  # heavy prefixes, so that they are lengthened
    for df in (documents(spark), odd):
        got = substring.remove_repeats(df.repartition(parts)).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_removed(text_rows(df))
        assert all(sum(s.last - s.first + 1 for s in r.spans) == r.n_removed for r in got)
    assert substring.remove_repeats(odd.limit(0)).count() == 0


# --- retrieval for packing ------------------------------------------------------------------------------


def test_neighbours_are_those_of_plain_bm25():
    """Ranking by the heaviest terms, and by the rest once no unused piece has one of those."""
    rng = np.random.default_rng(6)
    pieces = [rng.zipf(1.3, rng.integers(1, 90)).clip(0, 400).astype(np.uint32) for _ in range(60)]
    pieces += [np.arange(1000, 1040, dtype=np.uint32), np.arange(1030, 1041, dtype=np.uint32)]
    sizes = np.array(list(map(len, pieces)))
    index = packing.Index(np.concatenate(pieces), sizes)
    bags = [collections.Counter(p.tolist()) for p in pieces]
    df = collections.Counter(t for b in bags for t in b)

    def weight(d, t):
        idf = np.log1p((len(pieces) - df[t] + 0.5) / (df[t] + 0.5))
        norm = packing.K1 * (1 - packing.B + packing.B * sizes[d] / sizes.mean())
        return idf * bags[d][t] * (packing.K1 + 1) / (bags[d][t] + norm)

    def scores(terms, unused):
        return {d: s for d in np.flatnonzero(unused) if (s := sum(weight(d, t) for t in terms if t in bags[d])) > 0}

    for seed in range(len(pieces)):
        unused = rng.random(len(pieces)) < 0.4
        terms = sorted((t for t in bags[seed] if df[t] > 1), key=lambda t: (-weight(seed, t), t))
        want = scores(terms[:packing.QUERY_TERMS], unused) or scores(terms[packing.QUERY_TERMS:], unused)
        got = index.neighbours(seed, unused).tolist()
        assert len(got) == min(len(want), packing.NEIGHBOURS) and all(d in want for d in got)
        ranked = sorted(want.values(), reverse=True)[:len(got)]
        assert np.allclose([want[d] for d in got], ranked)


# --- pipeline ------------------------------------------------------------------------------------------


def brute_rest(text, gone):
    """The text without its removed words: a run goes with the white space after it, one at the text's end with that before it."""
    pieces = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)  # a word and the white space after it
    start = text[:len(text) - sum(map(len, pieces))]
    left = "".join(p for p, g in zip(pieces, gone) if not g)
    if gone and gone[-1]:
        left = left.rstrip(" \t\n\v\f\r") + re.search(r"[\x20\x09-\x0D]*$", text)[0]
    return start + left


def test_pipeline(spark):
    """Against the same stages in plain Python; language and packing by what must hold."""
    rows = text_rows(documents(spark))
    known = [(d, t) for d, t in rows if t and re.search(r"[^\W\d_]", t)]
    firsts = {c for _, c, _ in brute_classes(known)}
    stay = [(d, t) for d, t in known if d in firsts]
    texts = [(d, brute_rest(t, gone)) for (d, t), (_, _, gone) in zip(stay, brute_gone(stay)) if not all(gone)]
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in decontam.find_leaks(spark.createDataFrame(texts, "doc_id bigint, text string"),
                                                   spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).collect()}
    whole = {d for d, t in texts for x in items if re.sub(r"\s+", " ", x) in t}
    assert whole <= leaks
    want = {d: len(encoder(BYTE).whole.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts if d not in leaks}
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    total = collections.Counter()
    for r in got:
        total[r.doc_id] += r.length
    assert dict(total) == want


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF_DIR).columns == docs.columns
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_stages_tell_documents_apart_by_text(spark):
    """Null and repeated doc_ids with different texts: only equal and near texts collapse, only leaking rows go."""
    leak = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").where("text is not null").first().text
    texts = [" ".join(f"{name}{i}" for i in range(40)) for name in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[1] + " end"), (7, texts[2]), (7, texts[3]), (7, texts[3]),
            (3, texts[4]), (5, texts[4]), (None, texts[4]), (None, f"x {leak} y"), (7, f"z {leak}"), (9, texts[5])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], documents(spark).schema)
    kept = text_rows(corpus_pipeline.near_duplicates(spark, docs, SF_DIR))
    first = [x for x in kept if x[1] in (texts[1], texts[1] + " end")]
    assert len(first) == 1 and first[0][0] is None
    want = [(None, texts[0]), (7, texts[2]), (7, texts[3]), (3, texts[4]), (9, texts[5])]
    assert sorted(map(str, kept)) == sorted(map(str, [*want, *first, *((d, t) for d, t in kept if leak in t)])) and any(leak in t for _, t in kept)
    clean = text_rows(corpus_pipeline.decontaminate(spark, docs, SF_DIR))
    assert sorted(map(str, clean)) == sorted(str(x) for x in rows if leak not in x[1])


def messy(spark):
    """Documents with paragraphs, null and repeated ids, a very long text, and columns that stages use themselves."""
    leak = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").where("text is not null").first().text
    other = " ".join(f"u{i}" for i in range(60))
    texts = ["One line\n\n  and   a paragraph.\r\n\tEnd ", f"new {other}\n{PASSAGE}\n\n  tail\tof it\n", f"{PASSAGE}\nold  first", f"a {leak} b", None, "", " \n ",
             "a word in Latin \u0000 letters", " ".join(f"w{i % 7000}x{i // 7000}" for i in range(90_000)) + "\n", "*** ---"]
    ids = [5, 9, 2, 9, 7, None, 8, None, 3, 4]
    rows = [(d, t, "en", "s", len(t or ""), 0.25, "own", "mine", True, b"k", f"p{i}", i) for i, (d, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, lang_pred string, "
                                       "payload string, Ambiguous boolean, __key binary, __first string, __leak int")


def test_stages_change_nothing_else(spark):
    """Every row that a stage keeps comes out as it went in, but for words that the substring stage removes."""
    docs = messy(spark)
    rows = docs.collect()
    letters = [r for r in rows if r.text and re.search(r"[^\W\d_]", r.text)]
    want = {"language_id": letters, "near_duplicates": rows, "decontaminate": [r for r in rows if r.doc_id != 9 or "new" in r.text]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF_DIR)
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        if name in want:
            assert sorted(map(str, got.collect())) == sorted(map(str, want[name])), name
    left = {r["__leak"]: r for r in corpus_pipeline.substring_dedup(spark, docs, SF_DIR).collect()}
    assert left[1].text == rows[1].text.replace(f"{PASSAGE}\n\n  ", "") and left[1].n_chars == len(left[1].text)
    assert all(left[i] == r for i, r in enumerate(rows) if i != 1) and len(left) == len(rows)
    assert left[1].score == 0.25 and left[1].payload == "mine" and bytes(left[1]["__key"]) == b"k"


def test_texts_without_removed_words(spark):
    words = [f"r{i}" for i in range(13)]
    run = " ".join(words)
    rows = [(1, run), (2, f"\n a\n\n{run}\r\n  b  \n"), (3, f"  {run}  \n"), (4, f"x\t{run}"), (5, f"{run} y {run}\n"), (6, f"{run}\n\nz\t"), (7, "keep \n this ")]
    got = {r.doc_id: r.rest for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: run, 2: "\n a\n\nb  \n", 3: "    \n", 4: "x", 5: "y\n", 6: "z\t", 7: "keep \n this "}


def test_short_items_are_found_exactly(spark):
    items = [(1, "Alpha"), (2, "beta, GAMMA"), (3, "one two three"), (4, "four five six seven"), (None, "beta gamma"), (6, ""), (7, None), (8, "delta")]
    docs = [(1, "alpha beta gamma alpha"), (2, "One two four THREE"), (3, "x four-five six seven one two three"), (4, None), (5, "beta"), (6, "gam ma")]
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(tuple(r) for r in got.select("doc_id", F.coalesce("item_id", F.lit(-1)), "first_word", "last_word", "distance", "item_words").collect()) == [
        (1, -1, 1, 2, 0, 2), (1, 1, 0, 0, 0, 1), (1, 2, 1, 2, 0, 2), (3, 3, 5, 7, 0, 3), (3, 4, 1, 4, 0, 4)]


@pytest.mark.parametrize("length", [5, 25])
def test_leak_index_grows_with_its_text(length):
    """The pickled index is some tens of times the text, however many items there are."""
    rng = np.random.default_rng(1)
    ratios = []
    for n in (400, 3200):
        texts = [" ".join(f"word{x}" for x in rng.integers(0, 10**6, length)) for _ in range(n)]
        index = decontam.Index(list(range(n)), texts, decontam.DISTANCE, decontam.RECALL)
        ratios.append(len(pickle.dumps(index)) / sum(map(len, texts)))
    print(length, ratios)
    assert ratios[1] < 1.1 * ratios[0] or ratios[1] < 40

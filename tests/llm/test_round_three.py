"""Hard negatives, token counts and spelling variants against plain versions, on awkward rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberline.llm import negatives, queries, spelling, transducer

BYTE = queries.tokenizer("byte_bpe_50k.json")


# --- hard negatives --------------------------------------------------------------------


def plain_negatives(rows, anchors, k=5, m=3):
    """rows: {id: (label, vector of integers)}."""
    out = set()
    for a in anchors:
        label, v = rows[a]
        ranked = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, (_, w) in rows.items() if i != a and len(w) == len(v))
        for p, pid in [r for r in ranked if rows[r[1]][0] == label][:k]:
            fit = [(s, i) for s, i in ranked if rows[i][0] != label and 50 * -p <= 100 * -s <= 95 * -p]
            out |= {(a, pid, rank, i, -p, -s) for rank, (s, i) in enumerate(fit[:m], 1)}
    return out


@pytest.mark.parametrize("spread", [0.3, 40.0, 3e5])
def test_packed_products_are_exact(spread):
    rng = np.random.default_rng(1)
    a, c = (np.floor(rng.normal(0, spread * 256, (n, 33))).astype(np.int64) for n in (7, 50))
    low = int(a.min())
    packed = negatives.Packed(c, low, int(a.max()) - low)
    assert packed.doubles == (spread < 100) and packed.fields >= (2 if spread < 1 else 1)
    assert packed.scores(a).tolist() == [[int(sum(int(x) * int(y) for x, y in zip(q, w))) for w in c] for q in a]


def test_hard_negatives(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.normal(0, 1, 6)]) for i in range(0, 400)]
    rows += [(1000 + i, 1, rows[10][2]) for i in range(60)] + [(1100 + i, 2, rows[10][2]) for i in range(60)]  # copies: ties in score
    rows += [(2000, 1, [1.0, 2.0]), (2050, 1, [1.0, 2.0]), (2051, 0, [0.75, 1.5]), (2052, 0, []), (2100, 0, [])]
    rows += [(5, 9, [float("nan")] * 6), (None, 1, rows[0][2]), (3000, None, rows[0][2]), (3050, 1, None), (3100, 1, [None] * 6),
             (3150, 1, [float("inf")] * 6), (50, rows[50][1], rows[50][2])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumns({"rank": F.lit(1), "anchor": F.lit("clash")})
    monkeypatch.setattr(negatives, "GROUP_BYTES", 4096)  # several blocks and shards
    got = negatives.mine(negatives.quantised(df), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    known = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            known.setdefault(i, (label, [int(np.floor(256 * x)) for x in v]))
    assert {tuple(r) for r in got.collect()} == plain_negatives(known, [i for i in known if i % 50 == 0])
    assert negatives.mine(negatives.quantised(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


# --- token counts ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def compiled():
    return transducer.Compiled(BYTE, *transducer.character_runs(BYTE))


def library(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(BYTE).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def awkward_texts():
    rng = np.random.default_rng(3)
    letters = list("abcst'  \n\t,.!1²2é×ÀÿĀɏªº½'’ lrevdmI日Σ\x1c ") + ["<|endoftext|>", "<|endof", "text|>", " the", "ing", "😀", "'re", "'ll", "'ve"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(4000)]
    texts += ["".join(map(chr, rng.integers(32, 0x3000, 40))) for _ in range(500)]
    texts += ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 2000)) for _ in range(20)]
    return [*texts, None, "", "<|endof", "text|>", "'", "x" * 70_001, " " * 5000, "ab" * 30_000, "=-" * 5000, "日本" * 3000, "\n" * 77]


def test_counts_are_the_librarys(compiled, monkeypatch):
    texts = awkward_texts()
    size, n = compiled.counts(pa.array(texts, pa.string()))
    assert n.tolist() == library(texts) and size.tolist() == [len((t or "").encode()) for t in texts]
    monkeypatch.setattr(transducer, "BLOCK", 211)  # states carried over many borders
    monkeypatch.setattr(transducer, "TRANSITIONS", 1000)
    assert compiled.counts(pa.array(texts[:4500], pa.string()))[1].tolist() == n[:4500].tolist()
    assert compiled.counts(pa.array([], pa.string()))[1].tolist() == []


def test_state_maps_compose(compiled):
    rng = np.random.default_rng(8)
    kinds = rng.integers(0, transducer.CLASSES, 20_000).astype(np.uint8)
    for state in range(transducer.STATES):
        marks, states = compiled.marks(kinds, state)
        now, want = state, []
        for k in kinds.tolist():
            now, mark = transducer._splitter_step(now, k)
            want.append((mark, now))
        assert list(zip(marks.tolist(), states.tolist())) == want


def test_token_counts(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "x<|endoftext|>"), (2, None), (3, ""), (4, " ".join(f"long{i % 9000}" for i in range(60_000)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n_tokens": F.lit("clash"), "limit": F.lit(0)})
    got = sorted((tuple(r) for r in transducer.token_counts(df, BYTE, limit=2).collect()), key=str)
    want = [(d, len((t or "").encode()), n, n > 2) for (d, t), n in zip(rows, library([t for _, t in rows]))]
    assert got == sorted(want, key=str)
    assert transducer.token_counts(df.limit(0), BYTE).count() == 0
    with pytest.raises(ValueError):
        transducer.character_runs(queries.tokenizer("word_bpe_49k.json"))


# --- spelling variants -----------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_forms(words, factor=5):
    out = {}
    for w, n in words.items():
        near = [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= factor * n else None
        out[w] = (form, n, len(near), words[form] if form else None)
    root = {}
    for w in words:
        at = w
        while out[at][0]:
            at = out[at][0]
        root[w] = at
    return {(w, f, root[w], n, k, fn) for w, (f, n, k, fn) in out.items()}


@pytest.mark.parametrize("part", [16_384, 40])
def test_spelling_groups(spark, monkeypatch, part):
    rng = np.random.default_rng(11)
    words = {}
    for base in ("kitten", "aaaaaa", "çédille", "ÿÿÿÿÿÿÿ", "verylong" * 40, "prefixes"):
        words[base] = 10_000
        for _ in range(60):
            w = list(base)
            for _ in range(rng.integers(1, 4)):
                at, c = int(rng.integers(0, len(w))), rng.choice(list("aeinké"))
                w[at:at + int(rng.integers(0, 2))] = [c] * int(rng.integers(0, 2))
            if len(w) >= 6:
                words.setdefault("".join(w), int(rng.choice([5, 5, 30, 200, 2000])))
    monkeypatch.setattr(spelling, "PART_WORDS", part)  # 40: large groups are split into parts
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").withColumn("root", F.lit("clash"))
    got = spelling.group_variants(df)
    assert {tuple(r) for r in got.collect()} == plain_forms(words) and got.count() == len(words)
    assert spelling.group_variants(df.limit(0)).count() == 0


def test_two_letter_words(spark):
    words = {"ab": 100, "abc": 5, "b": 900, "ac": 20, "abcd": 1, "xb": 1}
    words = {w: n for w, n in words.items() if len(w) >= 2}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert {tuple(r) for r in spelling.group_variants(df, shortest=2).collect()} == plain_forms(words)


def test_runs_and_vocabulary(spark):
    rows = [(1, "Ämter ÄMTER x2y don't"), (1, None), (None, ""), (2, "***"), (3, "straßen " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("run", F.lit("clash"))
    got = spelling.runs(df)
    assert [r.run for r in got.where("doc_id = 1").collect()] == ["Ämter", "Ämter", "x", "y", "don", "t"]
    words = spelling.vocabulary(got.select(F.col("run").alias("word")), shortest=2, least=2)
    assert {tuple(r) for r in words.collect()} == {("Ämter", 2), ("straßen", 30_000)}

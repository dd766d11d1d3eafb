"""Fixed values that results depend on."""

# --- fixed values: band layout of the 27-channel vector (0-based) -------------
DAY_BANDS = 6
NIGHT_BANDS = 2
CORE_CHANNELS = 8
PRED_CHANNELS = 27
HEAT_CHANNELS = (3, 4, 6, 7)
DEGREE_CHANNELS = (12, 18, 24)
LANDCOVER_CHANNEL = 21
LANDCOVER_CLASSES = 17
TILE = 256
CROP_OFFSET = 128
BLOCK_FRAMES = 10

# --- fixed values: published per-channel means and deviations -----------------
PRED_MEAN = (
    18.224253, 26.95519, 20.09066, 318.25967, 308.78717, 14.165086, 291.29214,
    288.97382, 5110.5547, 2556.2627, 0.3907487, 3.4994626, 216.23518, 276.5463,
    291.8275, 70.32086, 0.0054306216, 10.120554, 175.33012, 1290.8367,
    -1.5219007, 7.3989105, 7.584937, 1.4395763, 3.306973, 19.259102,
    0.0057929577,
)
PRED_STD = (
    15.438321, 14.408274, 10.552524, 13.1312475, 12.155249, 9.652911,
    12.435288, 8.750125, 2400.766, 1206.8983, 2.37979, 1.6343528, 85.730644,
    47.332256, 50.045837, 22.48386, 0.0021515382, 8.429097, 104.73222,
    823.01483, 1.9954495, 4.1257873, 26.547232, 1.2017097, 48.207355,
    5.4114914, 0.0017134654,
)
AF_MEAN = (18.76488, 27.441864, 20.584806, 305.99478, 294.31738, 14.625097, 276.4207, 275.16766)
AF_STD = (15.911591, 14.879259, 10.832616, 21.761852, 24.703484, 9.878246, 40.64329, 40.7657)
BA_MEAN = (17.952442, 26.94709, 19.82838, 317.80234, 308.47693, 13.87255, 291.0257, 288.9398)
BA_STD = (15.359564, 14.336508, 10.64194, 12.505946, 11.571564, 9.666024, 11.495529, 7.9788895)

# --- fixed values: fire mask codes, inclusive ranges --------------------------
FIRE_CODE_RANGES = ((10, 15), (20, 25), (30, 35))
MASK_FILL = -99
POWER_FILL = -9999.0

# --- fixed values: sensor directories in order of preference ------------------
MASK_DIRS = ("mask_fixed", "mask")
FRP_DIRS = ("frp_fixed", "frp")
RASTER_SUFFIXES = ("tif", "tiff")

# --- fixed values: feature names ---------------------------------------------
DAILY_FEATURES = (
    "goes_mask_file_count", "goes_mask_cov_mean", "goes_mask_cov_max",
    "goes_frp_file_count", "goes_frp_mean_mean", "goes_frp_max_max",
)
SUBDAILY_FEATURES = ("active_pixel_count", "mask_coverage", "frp_mean", "frp_max")
CLIP_VARIABLES = ("Mask", "DQF", "Area", "Temp", "Power")

# --- fixed values: held-out fires --------------------------------------------
VALIDATION_FIRES = (
    "20568194", "20701026", "20562846", "20700973", "24462610", "24462788",
    "24462753", "24103571", "21998313", "21751303", "22141596", "21999381",
    "23301962", "22712904", "22713339",
)
TEST_EXCLUDED_FIRES = ("US_2021_NV3700011641620210517",)
AF_TEST_FIRES = (
    "elephant_hill_fire", "eagle_bluff_fire", "double_creek_fire",
    "sparks_lake_fire", "lytton_fire", "chuckegg_creek_fire", "swedish_fire",
    "sydney_fire", "thomas_fire", "tubbs_fire", "carr_fire", "camp_fire",
    "creek_fire", "blue_ridge_fire", "dixie_fire", "mosquito_fire",
    "calfcanyon_fire",
)

# --- fixed values: geometry ---------------------------------------------------
KM_PER_DEGREE_LAT = 110.574
KM_PER_DEGREE_LON = 111.320
POLE_GUARD = 1e-8
HALF_SIZE_KM = 128.0
# GRS80 semi-axes in metres, geostationary height, and the GOES-East longitude.
GRS80_EQUATOR = 6378137.0
GRS80_POLE = 6356752.31414
PERSPECTIVE_HEIGHT = 35786023.0
GOES_EAST_LON = -75.0

# --- fixed values: run-history vocabulary ------------------------------------
BOUNDED_METRICS = ("f1", "iou", "dice", "accuracy")
METRIC_FLOOR = 0.30
TARGET_IOU = 0.60
IMPROVEMENT_MARGIN = 0.01
LOG_TAIL_CHARS = 12000
DEFAULT_WINDOW = (6, 1)
DATASET_TOOL_PREFIX = "dataset_gen_"
SPATIAL_TOOL = "run_spatial_model"
PREDICTION_TOOL = "run_spatial_temp_model_pred"
TEMPORAL_TOOLS = ("run_spatial_temp_model", "run_spatial_temp_model_pred", "run_seq_model")
PARAM_ORDER = (
    "model", "attn_version", "num_heads", "embedding_dim", "learning_rate",
    "ts_length", "interval", "batch_size", "epochs", "mode", "sample_limit",
    "channels",
)
RESOURCE_DECISIONS = ("needs_resource_review", "retry_with_smaller_batch")
RESOURCE_WORDS = (
    "resource limits", "smaller training budget", "reduce model capacity",
    "smaller batch", "smaller temporal window",
)
UPGRADE_WORDS = (
    "upgrade", "longer temporal window", "switch attention",
    "increase model capacity", "lower the learning rate", "escalate",
)

# --- fixed values: log patterns ----------------------------------------------
METRIC_RE = r"(?i)(iou|dice|f1|accuracy)[^0-9]*([0-9]*\.?[0-9]+)"
TEST_SUMMARY_RES = (
    r"(?i)model\s+F1\s+Score:\s*([0-9]*\.?[0-9]+)\s*and\s*iou\s+score:\s*([0-9]*\.?[0-9]+)",
    r"(?i)Model\s+Test\s+F1\s+Score:\s*([0-9]*\.?[0-9]+)\s+and\s+Test\s+IoU\s+Score:\s*([0-9]*\.?[0-9]+)",
)
NO_DATA_RE = r"(?i)(No valid prediction sequences were generated|empty file list)"
NO_DATASET_RE = r"(?is)(FileNotFoundError|No such file or directory).*(dataset_train|dataset_val|dataset_test)"
OUT_OF_MEMORY_RE = r"(?i)(out of memory|cuda oom|cudnn_status_alloc_failed)"
SHORT_SERIES_RE = r"(?i)(No enough TS|empty file list)"
SHAPE_RE = r"(?i)(shape|size mismatch|expected.*channels|band)"
EPOCH_RE = r"checkpoint_epoch_(\d+)"

# --- fixed values: feature-set catalogue (task, name, channels, groups, status)
FEATURE_SETS = (
    ("af", "af_core8", 8, ("viirs_day", "viirs_night"), "implemented"),
    ("af", "af_day_only", 4, ("viirs_day",), "planned"),
    ("af", "af_night_heavy", 4, ("viirs_night", "thermal"), "planned"),
    ("pred", "pred_full43", 43, ("viirs_day", "viirs_night", "firepred", "landcover", "auxiliary"), "implemented"),
    ("pred", "pred_no_landcover", 23, ("viirs_day", "viirs_night", "firepred", "auxiliary"), "planned"),
    ("pred", "pred_no_firepred", 24, ("viirs_day", "viirs_night", "landcover", "auxiliary"), "planned"),
    ("pred", "pred_remote_only", 8, ("viirs_day", "viirs_night"), "planned"),
)

# Sentences of the step report, by what a step did to the primary metric.
_STEP = "Step {step}: [{strategy}] {tool} "
REASONING_LINES = {
    "no_metric": _STEP + "was chosen because {rationale} Decision: {decision}.",
    "first_after_debug": _STEP + "produced the first usable metric after a prior debug failure, yielding {name}={value}.",
    "first_result": _STEP + "established the first measurable result with {name}={value}.",
    "metric_changed": _STEP + "changed the primary metric from {previous} to {name}; the latest usable score was {name}={value}.",
    "improved": _STEP + "improved {name} by {delta}{after}",
    "reduced": _STEP + "reduced {name} by {delta}, suggesting the latest change was not helpful.",
    "no_change": _STEP + "produced no material change in {name}; the configuration likely plateaued.",
}

"""Names, words, limits and formats that decide results."""

# column kinds, in the order legends and composition tables list them
KIND_ORDER = [
    "numeric", "categorical", "datetime", "boolean",
    "text", "identifier", "constant", "empty",
]
NESTED_KIND = "unsupported_nested"
MODELABLE = ["numeric", "categorical", "boolean", "datetime"]

# words that make a two-valued string column boolean
BOOLEAN_WORDS = ["true", "false", "yes", "no", "y", "n", "t", "f", "0", "1"]

# file suffixes by reader
CSV_SUFFIXES = [".csv", ".tsv", ".txt"]
WORKBOOK_SUFFIXES = [".xlsx", ".xlsm"]
PARQUET_SUFFIXES = [".parquet", ".pq"]
JSON_SUFFIXES = [".json", ".jsonl", ".ndjson"]
SEPARATORS = [",", ";", "\t", "|"]

# cell texts a CSV reader treats as missing (the public pandas defaults)
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# limits
SAMPLE_ROWS = 50_000
FOLD_MAX = 1000
FOLD_RATIO = 0.5
DATE_SHARE = 0.85
TEXT_LENGTH = 25
HISTOGRAM_BINS = 20
TOP_VALUES = 8
MONTHS = 36
CORRELATION_FLOOR = 0.5
CORRELATION_PAIRS = 25
HIGH_MISSING_PCT = 40
HIGH_CARDINALITY = 50
FEW_ROWS = 50
MAX_CLASSES = 50
SMALL_DATA = 1_000
MAX_TRAIN_ROWS = 100_000
SILHOUETTE_ROWS = 5_000
RARE_SHARE = 0.01
MAX_CATEGORIES = 40

# tasks
BINARY = "binary_classification"
MULTICLASS = "multiclass_classification"
REGRESSION = "regression"
CLUSTERING = "clustering"
TASK_NAMES = {
    BINARY: "Binary classification",
    MULTICLASS: "Multiclass classification",
    REGRESSION: "Regression",
    CLUSTERING: "Clustering",
}
ALGORITHM_NAMES = {
    "gradient_boosting": "Gradient boosting",
    "random_forest": "Random forest",
    "logistic_regression": "Logistic regression",
    "decision_tree": "Decision tree",
    "ridge": "Ridge regression",
    "kmeans": "K-means",
    "dbscan": "DBSCAN",
    "isolation_forest": "Isolation forest",
}

# why an algorithm fits; {rows} and {features} are filled in
FIT_REASONS = {
    "classify": {
        "gradient_boosting": "handles mixed column types and missing values, usually the strongest here",
        "random_forest": "robust with {rows:,} rows and needs no tuning",
        "logistic_regression": "fast, and the coefficients read as plain per-column effects",
    },
    "regress": {
        "gradient_boosting": "captures non-linear effects across {features} features",
        "random_forest": "stable baseline that ignores feature scaling",
        "ridge": "linear baseline, tells you if the signal is simple",
    },
    "cluster": {
        "kmeans": "groups rows into clusters of similar behaviour",
        "dbscan": "finds clusters of any shape and marks leftovers as outliers",
        "isolation_forest": "flags the rows that do not fit any pattern",
    },
}
SMALL_TREE_REASON = "few rows to learn from, a single tree stays explainable"
LARGE_TREE_REASON = "one readable tree, usually beaten by the ensembles on data this size"
DBSCAN_ROWS = 20_000
WIDE_FEATURES = 50

# date texts that are recognised: (shape, Spark datetime pattern)
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}$", "yyyy-M-d H:mm"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}\.\d{1,9}$", "yyyy-M-d H:mm:ss.[SSSSSSSSS][SSSSSS][SSS][SS][S]"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$", "yyyy-MM-dd'T'HH:mm:ssX"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ssxxx"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,9}$", "yyyy-MM-dd'T'HH:mm:ss.[SSSSSSSSS][SSSSSS][SSS][SS][S]"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{3,} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Z][a-z]{3,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$", "d-MMM-yyyy"),
]

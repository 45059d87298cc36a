"""Fixed values.

Everything in this module is a fixed value of the data model: word lists, name patterns,
thresholds, vocabularies and message texts that results must carry literally.
"""

# ---- fixed values: file suffixes that a table may have ----
CSV_SUFFIXES = (".csv",)
# Texts that mean a missing value in delimited files.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
TAB_SUFFIXES = (".tsv", ".txt")
JSON_SUFFIXES = (".json",)
JSON_LINES_SUFFIXES = (".jsonl", ".ndjson")
PARQUET_SUFFIXES = (".parquet",)

# ---- fixed values: profile limits ----
MAX_SAMPLE_VALUES = 5
MAX_TOP_VALUES = 10
DATETIME_PARSE_RATE = 0.8

# ---- fixed values: role inference ----
ID_NAME_PATTERN = r"(^id$|_id$|^id_|identifier|uuid|guid|key$|code$|number$|no$)"
TARGET_NAME_PATTERN = (
    r"(target|label|class|y$|churn|default|fraud|outcome|result|score|price|sales)"
)
BINARY_PAIRS = (("0", "1"), ("true", "false"), ("yes", "no"), ("y", "n"))
HIGH_CARDINALITY_THRESHOLD = 0.8
CATEGORICAL_UNIQUE_THRESHOLD = 20
ID_MIN_ROWS = 10
TEXT_AVERAGE_LENGTH = 40
SUPERVISED_TASKS = ("classification", "regression", "forecasting")
MODELING_TASKS = ("classification", "regression", "forecasting", "clustering")

REASON_EXPLICIT_TARGET = "matches explicit target_column"
REASON_EXPLICIT_TIME = "matches explicit time_column"
REASON_DATETIME = "column has datetime summary or datetime dtype"
REASON_ID = "column name or high unique rate indicates identifier"
REASON_TYPE = "inferred from pandas_type="
REASON_CANDIDATE = "column name looks like a possible target"
REASON_UNKNOWN = "semantic type is uncertain"
REASON_TEXT = "string samples look like free text"
REASON_HIGH_CARDINALITY = "categorical column has high cardinality"
REASON_MISSING = "missing_rate="

WARN_TARGET_ABSENT = "explicit target_column not found in profile: "
WARN_TIME_ABSENT = "explicit time_column not found in profile: "
WARN_REVIEW_CANDIDATES = "no explicit target column matched; review target_candidates."
WARN_NO_TARGET = "no target column inferred for supervised task."
WARN_NO_TIME = "no time_index column inferred for forecasting task."
WARN_CLUSTER_TARGET = "clustering tasks usually should not have a target column."

# ---- fixed values: quality thresholds, then (message, recommendation) per issue type.
# %s stands for the column name or the number the message quotes. ----
HIGH_MISSING_RATE = 0.4
CLASS_IMBALANCE_RATE = 0.9
MIN_ROWS_WARNING = 50
ISSUE_TEXTS = {
    "empty_dataset": (
        "Dataset has zero rows.",
        "Provide a non-empty dataset before modeling.",
    ),
    "too_few_rows": (
        "Dataset has only %s rows.",
        "Review whether there is enough data for reliable modeling.",
    ),
    "duplicate_rows": (
        "Dataset contains %s duplicate rows.",
        "Consider dropping duplicate rows during preprocessing.",
    ),
    "all_missing_column": (
        "Column %s is entirely missing.",
        "Drop the column or provide data for it before modeling.",
    ),
    "high_missing_rate": (
        "Column %s has high missing rate.",
        "Consider imputation, dropping the column, or asking the user to confirm its meaning.",
    ),
    "constant_column": (
        "Column %s has only one non-null value.",
        "Drop constant columns during preprocessing.",
    ),
    "no_feature_columns": (
        "No usable feature columns were inferred.",
        "Review schema inference or provide feature columns before modeling.",
    ),
    "target_missing": (
        "No target column is available for a supervised task.",
        "Ask the user to provide or confirm the target column.",
    ),
    "target_not_found": (
        "Target column %s is not present in the profile.",
        "Check the data file or requirement definition target_column.",
    ),
    "target_missing_values": (
        "Target column %s contains missing values.",
        "Drop rows with missing target or ask the user to provide complete labels.",
    ),
    "target_single_class": (
        "Target column %s has fewer than two classes.",
        "Provide labels with at least two classes before classification.",
    ),
    "class_imbalance": (
        "Target column %s is highly imbalanced.",
        "Use stratified splitting and imbalance-aware metrics or resampling.",
    ),
    "time_index_missing": (
        "No time index column is available for forecasting.",
        "Ask the user to provide or confirm the time column.",
    ),
    "time_index_not_parseable": (
        "Time column %s was not profiled as parseable datetime.",
        "Parse and validate the time column during preprocessing.",
    ),
    "high_cardinality_categorical": (
        "Column %s is a high-cardinality categorical feature.",
        "Avoid naive one-hot encoding; consider hashing, target encoding with care, or dropping it.",
    ),
    "possible_id_leakage": (
        "Identifier column %s is included as a feature.",
        "Remove ID-like columns from model features unless explicitly justified.",
    ),
}

# ---- fixed values: plan vocabulary ----
PLAN_STATUSES = ("executable", "need_info", "rejected")
TASK_TYPES = ("classification", "regression", "forecasting", "clustering", "unknown")
MISSING_STRATEGIES = (
    "none", "drop_rows", "drop_column", "mean", "median", "mode", "constant",
    "ffill", "bfill", "custom",
)
ENCODINGS = (
    "none", "one_hot", "ordinal", "target", "frequency", "hashing", "drop", "custom",
)
SCALINGS = ("none", "standard", "minmax", "robust", "log", "custom")
TEXT_METHODS = ("none", "tfidf", "embedding", "drop", "custom")
DATETIME_METHODS = (
    "none", "extract_parts", "cyclical", "sort_index", "resample", "drop", "custom",
)
SPLIT_STRATEGIES = ("none", "random", "stratified", "time_based", "predefined", "custom")
ARTIFACT_TYPES = (
    "train_data", "validation_data", "test_data", "full_processed_data",
    "feature_report", "preprocessor", "metadata", "other",
)
DEFAULT_RANDOM_STATE = 42

PLAN_ERRORS = {
    "plan_name": "plan_name cannot be empty.",
    "input_files": "executable data plan requires input_files.",
    "target_column": "%s data plan requires target_column.",
    "time_column": "forecasting data plan requires time_column.",
    "feature_columns": "executable data plan requires feature_columns.",
    "output_artifacts": "executable data plan requires output_artifacts.",
    "need_info": "need_info data plan requires user_facing_response.",
    "rejected": "rejected data plan requires user_facing_response.",
    "columns": "columns cannot be empty.",
    "path": "path cannot be empty.",
    "action": "action cannot be empty.",
    "list_item": "list item cannot be empty.",
    "fill_value": "constant missing strategy requires fill_value.",
    "size_range": "split sizes must be between 0 and 1.",
    "size_sum": "split sizes cannot sum to more than 1.",
    "stratify": "stratified split requires stratify_column.",
    "time_split": "time_based split requires time_column.",
}

# ---- fixed values: task definitions and their gate ----
DECISIONS = ("accepted", "need_info", "need_confirmation", "rejected")
GATE_ERRORS = {
    "task_type": "task_type must be one of classification, regression, forecasting, "
    "or clustering to enter modeling.",
    "decision": "decision must be accepted to enter modeling.",
    "should_model": "should_model must be true to enter modeling.",
    "critical": "missing_information.critical must be empty to enter modeling.",
    "data_type": "input_mode.data_type cannot be unknown for accepted tasks.",
    "required_inputs": "input_mode.required_inputs must not be empty.",
    "target_column": "%s tasks must specify input_mode.target_column.",
    "time_column": "forecasting tasks must specify input_mode.time_column.",
    "prediction_type": "output_mode.prediction_type cannot be unknown for accepted tasks.",
    "target_description": "output_mode.target_description must not be empty.",
    "output_format": "output_mode.output_format must not be empty.",
    "primary_metric": "evaluation.primary_metric must not be empty for accepted tasks.",
}
GATE_WARNINGS = {
    "optional": "missing_information.optional must be confirmed before modeling.",
    "granularity": "forecasting tasks should specify input_mode.data_granularity.",
    "cluster_target": "clustering tasks usually should not specify a target_column.",
    "validation": "evaluation.validation_strategy should not be empty.",
}
GATE_NEED_INFO_INTRO = (
    "当前需求属于支持的建模类型，但缺少进入自动建模所需的关键信息，暂不继续建模。请补充：\n"
)
GATE_CONFIRM_INTRO = (
    "当前需求的关键信息已经足够，可以进入建模；但仍缺少一些可选信息，"
    "补充后可能提升建模质量。请补充以下信息，或回复 yes 直接继续：\n"
)
TASK_RESPONSES = {
    "optional": "当前需求的关键信息已经足够，可以进入建模；但仍缺少一些可选信息。请补充这些信息，或回复 yes 直接继续建模。",
    "need_info": "当前需求可以建模，但缺少关键信息，请补充后再继续。",
    "need_confirmation": "当前需求可以建模，但缺少一些可选信息。是否继续建模？",
    "rejected": "当前需求不能明确归类为 classification、regression、forecasting 或 clustering，因此暂不进入自动建模。",
}
DATA_TYPES = ("tabular", "text", "image", "time_series", "multimodal", "unknown")
PREDICTION_TYPES = ("class_label", "probability", "numeric_value", "future_value", "cluster_id", "unknown")
# The fields of a task definition, and of those of its fields that hold others.
TASK_FIELDS = (
    "task_name", "task_type", "decision", "should_model", "problem_statement", "input_mode", "output_mode", "constraints", "evaluation",
    "assumptions", "missing_information", "user_facing_response", "downstream_notes", "raw_user_request",
)
TASK_INNER_FIELDS = {
    "input_mode": (
        "data_type", "required_inputs", "optional_inputs", "target_column", "id_columns", "time_column", "data_granularity", "known_data_sources",
    ),
    "output_mode": ("prediction_type", "target_description", "output_format"),
    "constraints": ("must_have", "must_not", "resource_limits", "privacy_or_safety"),
    "evaluation": ("primary_metric", "secondary_metrics", "validation_strategy", "metric_reasoning"),
    "downstream_notes": ("for_research_agent", "for_data_agent", "for_train_agent", "for_evaluation_agent"),
}
CONFIRMED_ASSUMPTION = "用户确认在缺少以下可选信息时继续建模: "
CONFIRMED_JOINER = "；"
CONFIRMED_RESPONSE = "已确认在缺少可选信息的情况下继续进入后续建模。"

# ---- fixed values: task states, decision -> (status, next step) ----
TASK_STATES = {
    "accepted": ("ready_for_modeling", "Continue with research_agent or data_agent."),
    "need_info": (
        "waiting_for_required_information",
        "Ask the user to provide critical missing information.",
    ),
    "need_confirmation": (
        "waiting_for_optional_confirmation",
        "Ask the user to provide optional information or reply yes.",
    ),
    "rejected": ("rejected", "Return the rejection message to the user."),
}

# ---- fixed values: event logs ----
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
ID_WIDTH = 4
FENCE_PATTERN = r"(?s)```([A-Za-z0-9_-]*)\s*\n(.*?)```"

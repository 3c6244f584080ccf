"""Message schema and the fixed values of the message-risk rules."""

from __future__ import annotations

#: The message columns in file order.
COLUMNS = ("content", "nature", "fake_probability", "source", "publish_time", "process_time")
#: What people say of a message.
FALSE, TRUE, NEUTRAL, UNVERIFIED = "虚假", "真实", "中立", "未校验"
NATURES = (FALSE, TRUE, NEUTRAL, UNVERIFIED)
LABELLED = (FALSE, TRUE, NEUTRAL)

#: What the CSV reader takes for a missing value.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: What a model run says of a message that failed without details, and of a score that isn't one.
RUN_FAILED, RUN_INVALID = "failed", "invalid score"
#: Constants of scoring, and limits and thresholds.
K1, B = 1.5, 0.75
INDEX_VERSION = 1
HOT_LIMIT, HOT_MIN_DF, HOT_MAX_DF_RATIO, HOT_MIN_LENGTH = 20, 2, 0.9, 2
SEARCH_LIMIT, PAGE_SIZE = 3, 20
MESSAGE_LIMIT, REASON_LIMIT = 6000, 2000
THRESHOLD, SWEEP = 50.0, (50.0, 30.0, 40.0, 60.0, 70.0)
CHECKPOINT_EVERY, ATTEMPTS, SESSION_DAYS, VALIDATION_SHARE = 20, 2, 3, 0.1

#: Labels of risk levels and of the classes of a classifier.
LEVEL_LABELS = {"low": "低风险", "medium": "中风险", "high": "高风险", "uncertain": "无法判断"}
LABEL_MEANING = ("非谣言", "谣言")
#: Part-of-speech tags of content words.
HOT_POS = ("n", "nr", "ns", "nt", "nz", "nl", "ng", "v", "vd", "vn", "vg", "a", "ad", "an", "ag", "i", "j", "l", "s")

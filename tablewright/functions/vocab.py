"""Word lists, thresholds and formats that decide results.

Everything here must stay as it is for results to match; no logic lives here.
"""

# Spellings of "no value", compared after trimming and lower-casing.
NULL_MARKERS = (
    "none", "null", "nan", "na", "n/a", "", "-", "--", "?",
    "unknown", "undefined", "nil",
    "missing", "not available",
    "n.a", "n.a.", "#n/a", "#na", "tbd", "tbc", "n/a.", "not applicable", "na.", "n/a -",
    "not provided", "n/p",
    "error", "err", "#error", "#error!", "#value!", "#ref!", "#div/0!", "#name?", "#num!", "#null!",
    "invalid", "corrupt", "bad", "void",
)

# Literal spellings counted (case-sensitively, untrimmed) as missing in raw input.
RAW_MISSING_LITERALS = ("None", "none", "NULL", "null", "nan", "NaN", "NA", "N/A")

CURRENCY_SIGNS = "₹$€£¥₩"

TRUE_WORDS = ("yes", "y", "true", "t", "1", "on", "enabled", "positive", "correct", "right",
              "affirmative")
FALSE_WORDS = ("no", "n", "false", "f", "0", "off", "disabled", "negative", "incorrect", "wrong")

# Characters replaced before the special-character sweep: dropped, or turned into a space.
DROPPED_CHARACTERS = "\u2019\u2018\u201c\u201d\u2026\u200b\u200e\u200f\ufeff\u00ad"
SPACED_CHARACTERS = "\u2013\u2014\u00a0\r\n\t"
CONTROL_PATTERN = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SPECIAL_PATTERN = r"[:.,\-_!;\"'?/*#@|\\+=(){}\[\]<>^~`%]"

# --- dates -----------------------------------------------------------------
DATE_WORDS = ("date", "time", "dt", "created", "updated", "at", "on", "day", "month", "year",
              "dob", "birth", "timestamp", "period", "transaction_date", "invoice_date",
              "order_date")
DURATION_WORDS = ("mins", "minute", "minutes", "min", "hrs", "hour", "hours", "secs", "second",
                  "seconds", "sec", "days_taken", "duration", "elapsed", "taken", "turnaround",
                  "ttl", "latency", "delay")
NO_SPLIT_FRAGMENTS = ("dob", "birth", "created_at", "updated_at", "modified", "timestamp")
DERIVED_SUFFIXES = ("_year", "_month", "_month_name")
BARE_NUMBER_PATTERN = r"^-?[0-9]+(\.[0-9]+)?$"
DATE_SIGNAL_PATTERN = (r"(?i)[-/]|:|,|\b[0-9]{4}\b|"
                       r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b")
MONTH_NAME_PATTERN = (r"(?i)\b(january|february|march|april|may|june|july|august|september|october|"
                      r"november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\b")
LEADING_DATE_PATTERN = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}|^[0-9]{2}-[0-9]{2}-[0-9]{4}|"
                        r"^[0-9]{2}/[0-9]{2}/[0-9]{4}|^[0-9]{4}/[0-9]{2}/[0-9]{2}|^[0-9]{8}$")
DAY_FIRST_FORMATS = ("d-M-yyyy H:mm:ss", "d-M-yyyy H:mm", "d-M-yyyy", "d/M/yyyy H:mm:ss",
                     "d/M/yyyy")
MONTH_FIRST_FORMATS = ("M-d-yyyy H:mm:ss", "M-d-yyyy H:mm", "M-d-yyyy", "M/d/yyyy H:mm:ss",
                       "M/d/yyyy")
GENERAL_FORMATS = ("yyyy-M-d H:mm:ss", "yyyy-M-d H:mm:ss.SSSSSS", "yyyy-M-d H:mm", "yyyy-M-d",
                   "yyyy/M/d H:mm:ss", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy",
                   "MMMM d yyyy", "MMM-yyyy", "MMMM-yyyy", "MMM yyyy", "MMMM yyyy", "M/yyyy",
                   "yyyyMMdd")
# Spellings outside the ladder, tried where nothing above fits.
WIDER_FORMATS = ("yyyy-M-d'T'H:mm:ss", "yyyy-M-d'T'H:mm:ss.SSSSSS", "yyyy-M-d'T'H:mm", "yyyy-M-d'T'H:mm:ssXXX",
                 "yyyy-M-d'T'H:mm:ss.SSSSSSXXX", "yyyy-M-d H:mm:ssXXX", "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy",
                 "d MMM, yyyy", "d-MMMM-yyyy", "MMM-d-yyyy", "d.M.yyyy H:mm:ss", "d.M.yyyy H:mm", "d.M.yyyy", "yyyy.M.d", "d-MMM-yy")
WIDER_DAY_FIRST = ("d/M/yyyy H:mm", "d/M/yyyy h:mm a", "d/M/yyyy h:mm:ss a", "d-M-yyyy h:mm a", "d/M/yy", "d-M-yy")
WIDER_MONTH_FIRST = ("M/d/yyyy H:mm", "M/d/yyyy h:mm a", "M/d/yyyy h:mm:ss a", "M-d-yyyy h:mm a", "M/d/yy", "M-d-yy")
# Month-with-year spellings outside the ladder above.
MONTH_YEAR_FORMATS = ("MMM/yyyy", "MMMM/yyyy", "yyyy-MMM", "yyyy MMM", "yyyy/MMM", "yyyy-MMMM",
                      "yyyy MMMM", "yyyy/MMMM", "M-yyyy", "MMM-yy", "MMM yy", "MMMM-yy",
                      "MMMM yy")
DATE_PARSE_SHARE = 0.75
UNIX_SECONDS_RANGE = (1e9, 2e10)
UNIX_SECONDS_SHARE = 0.50
DATE_SIGNAL_SHARE = 0.60
BARE_NUMBER_SHARE = 0.50
TWO_DIGIT_YEAR_PIVOT = 50

NUMERIC_SHARE = 0.50
LOOSE_NUMERIC_SHARE = 0.80

# --- column roles by name ---------------------------------------------------
NON_NEGATIVE_WORDS = (
    "amount", "price", "cost", "revenue", "sales", "fee", "charge", "payment", "salary", "wage",
    "income", "loan", "budget", "tax", "invoice", "total", "mrp", "unit_price", "subtotal",
    "shipping", "time", "duration", "minutes", "hours", "days", "age", "count", "quantity", "qty",
    "volume", "units", "stock", "inventory", "distance", "weight", "height",
)
SIGNED_WORDS = ("balance", "credit", "debit", "profit", "loss", "margin", "refund", "chargeback",
                "adjustment", "variance", "delta", "change", "net")
RATING_WORDS = ("rating", "score", "stars", "review_score", "satisfaction", "nps")
RATING_DEFAULT = (1.0, 5.0)
RATING_CEILINGS = (5.0, 10.0, 50.0, 100.0)
PERCENT_WORDS = ("percent", "pct", "discount", "utilization", "conversion_rate", "churn_rate")
PERCENT_RANGE = (0.0, 100.0)
ID_FRAGMENTS = ("sku", "upc", "ean", "barcode", "iban", "ifsc", "swift", "account_number",
                "card_number", "routing_number", "gstin", "pan", "order_number", "invoice_number",
                "tracking_number", "awb")
DIGIT_ID_FRAGMENTS = ("account", "phone", "mobile", "zip", "pin", "contact")
LETTERED_ID_FRAGMENTS = ("sku", "upc", "ean", "barcode", "iban", "gstin", "pan", "order_number",
                         "invoice_number", "tracking_number", "awb")
NAME_LIKE_FRAGMENTS = ("name", "city", "town", "country", "region", "state", "province",
                       "product", "brand", "category", "item")
IDENTIFIER_FRAGMENTS = ("id", "code", "key", "_no", "number", "ssn", "zip")
KEY_ENDINGS = ("id", "key", "code", "no", "number", "ssn", "zip")
SEGMENT_IDENTIFIER_FRAGMENTS = ("id", "code", "key", "number")
STRUCTURAL_FRAGMENTS = ("_id", "row_number", "index", "record_id", "seq", "serial", "uuid",
                        "guid", "hash")

# --- statistics -------------------------------------------------------------
MIN_PERIOD_ROWS = 10
MIN_PERIOD_SHARE = 0.05
EDGE_SHARE = 0.05
EDGE_MIN_ROWS = 3
VOLUME_Z = 2.5
VOLUME_MIN_PERIODS = 4
NON_COMPLETED_FRAGMENTS = ("cancel", "fail", "refund", "pending", "reject", "void", "return",
                           "chargeback", "declin", "abandon")
STATUS_FRAGMENTS = ("status",)
MONEY_FRAGMENTS = ("revenue", "amount", "total", "sales", "price", "value", "gmv", "fare",
                   "charge")
MAX_KPIS = 6
STRONG_CORRELATION = 0.6
CATEGORY_MAX_DISTINCT = 60
CATEGORY_MAX_RATIO = 0.05
CHART_MAX_DISTINCT = 12
CHART_MIN_TOP_PCT = 5.0
CONCENTRATION_PCT = 40.0
SKEW_GAP_SHARE = 0.15

# --- deduplication ----------------------------------------------------------
MIN_ID_UNIQUENESS = 0.95
MAX_ID_REMOVAL = 0.30
RETENTION_WARN_PCT = 90.0

# --- fuzzy matching: (longest length that counts as short, short share, long share, distance)
FUZZY_VALUES = (6, 0.20, 0.30, 2)
FUZZY_ROWS = (6, 0.20, 0.15, 3)

# --- imputation -------------------------------------------------------------
IMPUTE_MAX_MISSING_PCT = 70.0
IMPUTE_FEATURE_MAX_MISSING = 0.5
IMPUTE_MIN_KNOWN = 5
FOREST_DEPTH = 10
FOREST_TREES = 150
FOREST_TREES_WIDE = 60
FOREST_WIDE_AFTER = 6
FOREST_CLASS_DISTINCT = 10
FILL_TEXT = "UNKNOWN"

# --- KPI strip: whole-token rules for what counts as revenue -----------------
REVENUE_TOKENS = ("revenue", "sales", "gmv", "earnings", "income", "turnover", "spent", "spend",
                  "fare", "proceeds", "billings", "collections")
TOTAL_TOKENS = ("total", "grand", "net", "sum", "gross")
MONEY_TOKENS = ("amount", "price", "cost", "value", "charge", "fee", "paid", "due")
UNIT_TOKENS = ("unit", "per", "avg", "average", "mean", "median", "rate", "ratio")
PRIORITY_FRAGMENTS = ("revenue", "sales", "profit", "cost", "price", "amount", "total",
                      "quantity", "volume", "orders", "transactions")

# (keywords, label, value prefix); the longest matching keyword wins, a prefix breaks
# equal lengths, then the earlier entry.
BUSINESS_LABELS = (
    (("revenue", "sales", "income", "turnover", "gmv", "spent", "spending", "proceeds"),
     "Revenue", "$"),
    (("profit", "margin", "earnings", "ebit", "ebitda", "net"), "Profit", "$"),
    (("cost", "expense", "cogs", "opex"), "Cost", "$"),
    (("price", "rate", "fee", "tariff", "charge", "amount"), "Price", "$"),
    (("quantity", "qty", "units", "volume", "sold", "orders"), "Volume", ""),
    (("customer", "client", "user", "member", "subscriber"), "Customers", ""),
    (("transaction", "txn", "purchase", "order", "invoice"), "Transactions", ""),
    (("discount", "promo", "rebate", "coupon", "offer"), "Discount", "$"),
    (("rating", "score", "nps", "csat", "review", "stars"), "Score", ""),
    (("age", "tenure", "duration", "days", "months", "years"), "Duration", ""),
    (("weight", "kg", "lb", "gram", "ton"), "Weight", ""),
    (("growth", "change", "delta", "variance", "diff"), "Growth", ""),
    (("tax", "vat", "gst", "levy", "duty"), "Tax", "$"),
    (("salary", "wage", "pay", "compensation", "bonus"), "Salary", "$"),
    (("inventory", "stock", "units_on_hand", "available"), "Inventory", ""),
    (("clicks", "impressions", "ctr", "conversion", "bounce"), "Engagement", ""),
    (("count", "num", "freq", "visits", "hits"), "Count", ""),
    (("total", "sum"), "Total", ""),
)

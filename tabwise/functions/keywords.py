"""Word lists matched against lower-cased column names.

Every list can be overridden per call where an operator uses it.
"""

# These lists decide results and are stated as given.

ID_WORDS = ("id", "key", "code", "no", "num", "identifier")
ID_EXACT = ("uuid", "index")
ID_EXACT_LOW_RATIO = ("employee_id", "customerid", "customer_id", "id", "index", "uuid")

BOOLEAN_TOKENS = ("true", "false", "yes", "no", "1", "0")

DATE_ROLE_WORDS = ("date", "time")
DATE_LIST_WORDS = ("date", "time", "year", "month", "day")
NOT_DATE_WORDS = (
    "income", "charge", "salary", "revenue", "sales", "spend", "cost", "amount", "bill", "payment",
)

CURRENCY_WORDS = (
    "amount", "revenue", "sales", "income", "turnover", "price", "cost", "salary", "charge", "bill",
    "payment", "spend", "budget", "profit", "margin", "tax", "fee",
)
PERCENTAGE_WORDS = ("rate", "ratio", "pct", "percent", "percentage", "share", "margin")
GEO_WORDS = (
    "region", "country", "state", "city", "zip", "lat", "long", "address", "postal", "county",
    "province", "territory", "location",
)
TARGET_WORDS = (
    "attrition", "churn", "status", "label", "class", "target", "y", "outcome", "default", "fraud",
    "click", "conversion", "satisfaction", "rating",
)
NON_NEGATIVE_WORDS = ("sales", "revenue", "price", "amount", "quantity", "income", "charge")
CUSTOMER_WORDS = ("cust", "client", "emp")

# Domain by substring of the joined column names; first match wins.
DOMAIN_WORDS = (
    ("Sales & Revenue", ("sales", "revenue", "amount", "price")),
    ("Human Resources", ("employee", "salary", "attrition")),
    ("Customer Churn", ("churn", "customer", "charges")),
)
DOMAIN_DEFAULT = "Operations Performance"

# Domain by exact column name; first match wins.
DOMAIN_EXACT = (
    ("Sales", ("sales", "revenue", "amount", "price")),
    ("HR", ("employee", "salary", "attrition", "tenure")),
    ("Finance", ("budget", "ebitda", "profit", "charges")),
    ("Marketing", ("conversion", "clicks", "cac", "roas")),
)
DOMAIN_EXACT_DEFAULT = "General Operations"

# KPI column choice by substring.
KPI_REVENUE_WORDS = ("sales", "revenue", "amount", "price")
KPI_VOLUME_WORDS = ("qty", "quantity", "orders")
KPI_HR_FLAG_WORDS = ("attrition", "churn", "left")
KPI_HR_PAY_WORDS = ("income", "salary", "pay")
KPI_CHURN_FLAG_WORDS = ("churn", "attrition", "cancel")
KPI_CHURN_CHARGE_WORDS = ("charge", "spend", "bill")
HR_TRUTHY = ("yes", "true", "1")
CHURN_TRUTHY = ("yes", "true", "1", "churn")

# Text read as missing from CSV files (the default list of pandas.read_csv).
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

UNKNOWN = "Unknown"

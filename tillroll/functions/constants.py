"""Fixed values that must equal the analysed application's for equal results.

Everything here is a plain literal, listed in its natural order.  Operators
take these as default arguments; callers may pass their own.
"""

# --- fixed values: shift labels and bins [start hour, end hour) -----------
SHIFT_MORNING = "Morning (06–14)"
SHIFT_AFTERNOON = "Afternoon (14–22)"
SHIFT_NIGHT = "Night (22–06)"
SHIFT_UNKNOWN = "Unknown"
MORNING_HOURS = (6, 14)
AFTERNOON_HOURS = (14, 22)

# --- fixed values: staffing parameters -------------------------------------
GHOST_PUNCH_HOURS = 0.5          # records with work_hours <= this are dropped
STAFF_BUFFER = 1.15              # recommended = ceil(mean * buffer), capped at max
UNDERSTAFFED_MIN = 2             # a slot is at risk when min staff < this

# --- fixed values: product segment keywords (upper-case substrings) --------
COFFEE_KEYWORDS = [
    "COFFEE", "ESPRESSO", "CAPPUCCINO", "LATTE", "AMERICANO",
    "MOCHA", "FLAT WHITE", "MACCHIATO", "FRAPPE", "HOT CHOCOLATE",
]
MILKSHAKE_KEYWORDS = ["MILKSHAKE", "SHAKE", "FRAPPE"]
CHIMNEY_KEYWORDS = ["CHIMNEY", "CONUT", "DONUT"]
SEGMENTS = ["coffee", "milkshake", "chimney_cake", "other"]

# --- fixed values: segment thresholds (percent of branch revenue) ----------
COFFEE_UNDER_PCT = 20.0
MILKSHAKE_UNDER_PCT = 10.0
BEVERAGE_TARGET_PCT = 35.0
BEVERAGE_AMBER_RATIO = 0.7

# --- fixed values: market-basket defaults ----------------------------------
EXCLUDED_ITEMS = ["DELIVERY CHARGE", "SERVICE CHARGE"]
MIN_SUPPORT = 0.02
MIN_CONFIDENCE = 0.3
MIN_LIFT = 1.2
MIN_BASKETS = 5
TOP_COMBOS = 10
TOP_PAIRS = 20

# --- fixed values: expansion signals ---------------------------------------
GROWING_PCT = 1.0                # mean monthly growth above this = growing
SATURATED_SHARE_PCT = 40.0       # a branch above this revenue share = saturated
DENSE_CUSTOMERS = 500            # network customers above this = dense
FEASIBLE_SIGNALS = 2
COMPETITION_WEIGHT = 0.3

# --- fixed values: demand forecast ------------------------------------------
FORECAST_BAND_LOW = 0.9
FORECAST_BAND_HIGH = 1.1
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

# --- fixed values: topic keywords, in tie-break order ------------------------
TOPIC_KEYWORDS = {
    "staffing": [
        "staff", "shift", "employee", "roster", "headcount", "worker",
        "schedule", "attendance", "crew", "understaffed", "overstaffed",
        "how many people", "how many staff",
    ],
    "combo": [
        "combo", "bundle", "pair", "together", "upsell", "basket",
        "buy", "association", "lift", "cross-sell", "frequently",
        "product pair", "promotion", "offer",
    ],
    "demand": [
        "demand", "forecast", "sales forecast", "predict", "projection",
        "next month", "next quarter", "volume", "units", "how much will",
        "how many units", "trending", "sales trend",
    ],
    "expansion": [
        "expand", "expansion", "new branch", "open", "location",
        "fifth branch", "5th branch", "where should", "site",
        "feasibility", "new store", "grow the network",
    ],
    "beverage": [
        "coffee", "milkshake", "shake", "beverage", "drink",
        "revenue share", "increase sales", "grow sales", "bev",
        "chimney cake", "pastry", "food mix", "product mix",
    ],
}
TOPIC_FALLBACK = "overview"

# --- fixed values: report boilerplate -----------------------------------------
FOOTER_PATTERN = r"(?i)Copyright|omegapos|Page \d+ of"
# in lower case, one of them is in any line with a footer
FOOTER_WORDS = ["copyright", "omegapos", "page "]
# words of page headers by layout: a row that holds one (item sales: begins with one) is no record
MONTHLY_HEADERS = ["Month", "Year", "Total", "Branch Name"]
ITEM_HEADERS = ["Description", "Barcode", "Total by", "Branch:", "Division:", "Group:"]
DELIVERY_HEADERS = ["Full Name", "Qty", "Description", "Price", "From Date", "To Date", "Page"]
CUSTOMER_HEADERS = ["Customer Name", "Address", "Phone", "First Order", "Page", "From Date"]
MENU_HEADERS = ["Menu Name", "# Cust", "Sales", "Avg", "Page", "Year"]
DIVISION_HEADERS = ["Page", "Year", "Summary"]
DIVISION_COLUMNS = ["DELIVERY", "TABLE", "TAKE AWAY", "TOTAL"]
DIVISION_NO_CATEGORY = ["TOTAL", "Total", "Copyright", "REP_", "www.", "Page", "Year"]
ATTENDANCE_BRANCH_MARKERS = ("Conut", "Main Street")
BRANCH_NAMES = ["Conut - Tyre", "Conut Jnah", "Main Street Coffee", "Conut"]
MENU_CHANNELS = ["DELIVERY", "TABLE", "TAKE AWAY"]

# --- fixed values: finding on the network's beverage share (share, benchmark, gap) -----
BEVERAGE_FINDINGS = {
    "green": "Beverage revenue at %1$s%% meets the %2$d%% benchmark.",
    "amber": "Beverage revenue at %1$s%% is below the %2$d%% industry benchmark. "
             "A %3$spp improvement would reach best-in-class.",
    "red": "Beverage revenue at %1$s%% is significantly below the %2$d%% benchmark. "
           "This represents a major untapped revenue opportunity.",
}

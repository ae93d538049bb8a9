"""Labels, cuts and headers a report must use to give the agreed results."""

# --- fixed values: input headers and the canonical column each one becomes ---
TRANSACTION_HEADERS = {
    "Transaction_ID": "txn_id",
    "Customer_ID": "customer_id",
    "Transaction_DateTime": "txn_ts",
    "Transaction_Type": "txn_type",
    "Channel": "channel",
    "Amount_NGN": "amount",
    "Transaction_Status": "status",
    "International_Transaction": "international",
    "Risk_Review_Flag": "risk_flag",
    "Device_Type": "device_type",
    "Location": "location",
}
CUSTOMER_HEADERS = {
    "Customer_ID": "customer_id",
    "Customer_Segment": "segment",
    "Account_Status": "account_status",
    "Preferred_Channel": "preferred_channel",
    "Device_Type": "device_type",
    "Location": "location",
}
CLEANED_COLUMNS = ("device_type", "location")
UNKNOWN = "Unknown"

# --- fixed values: categories ---
SUCCESSFUL, FAILED, REVERSED, PENDING = "Successful", "Failed", "Reversed", "Pending"
YES, NO = "Yes", "No"
CHANNELS = ("Mobile App", "POS", "Web", "ATM", "USSD")
FOCUS_CHANNEL = "Mobile App"

# --- fixed values: half-open amount bands, upper bound exclusive ---
AMOUNT_CUTS = (1_000, 10_000, 50_000, 100_000, 250_000)
AMOUNT_LABELS = ("1: under 1k", "2: 1k-10k", "3: 10k-50k", "4: 50k-100k", "5: 100k-250k", "6: 250k+")

# --- fixed values: age of a pending transaction in days, upper bound inclusive ---
AGE_CUTS = (1, 7, 30)
AGE_LABELS = ("1: 0-1 days", "2: 2-7 days", "3: 8-30 days", "4: over 30 days")

# --- fixed values: hour of day, upper bound exclusive ---
HOUR_CUTS = (6, 12, 18)
HOUR_LABELS = (
    "1: 00:00-05:59 night",
    "2: 06:00-11:59 morning",
    "3: 12:00-17:59 afternoon",
    "4: 18:00-23:59 evening",
)

# --- fixed values: minutes since the previous transaction, upper bound inclusive ---
FIRST_LABEL = "0: first transaction"
GAP_CUTS = (60, 1_440, 10_080)
GAP_LABELS = ("1: within 1 hour", "2: within 24 hours", "3: within 7 days", "4: over 7 days")

# --- fixed values: value tiers, last hundredth included in each ---
TIER_HUNDREDTHS = (1, 5, 20)
TIER_LABELS = (
    "1: top 1% of transactions",
    "2: next 4% (top 5%)",
    "3: next 15% (top 20%)",
    "4: remaining 80%",
)

# --- fixed values: rule scorecard ---
RULE_AMOUNT = 100_000
RULE_TYPES = ("Transfer", "Cash Withdrawal")
RULE_LABELS = ("R1: amount >= NGN 100k", "R2: R1 or international", "R3: R2 or Transfer/Cash Withdrawal")

# --- fixed values: recency / frequency / monetary segments ---
QUARTILE_SEGMENTS = ("Champions", "At-risk high value", "Low engagement", "Core customers")
QUINTILE_SEGMENTS = ("Champion", "Loyal", "At Risk", "Regular")

# --- fixed values: statistics ---
Z_CRITICAL_5PCT = 1.96
ALPHA = 0.05
SIGNIFICANT, NOT_SIGNIFICANT = "Significant at 5%", "Not significant at 5%"
WHISKER_IQRS = 1.5
MIN_COMBO_ROWS = 100
TOP_COMBOS = 10
FAILURE_TRIALS = 8
FAILURE_THRESHOLD = 3
HISTOGRAM_BINS = 60
PREVIEW_ROWS = 5
MILLION = 1_000_000

# Quartile scores from this one on count as high in the quartile segments.
HIGH_QUARTILE = 3

"""They decide results, so they are stated here in one place."""

# The order status that counts as a sale.
SENT = "Sent"

# Labels of the row that sums up everything outside the top n.
OTHERS_ALL_TIME = "others"
OTHERS_MONTHLY = "其他产品"

# A month of purchase frequency, in days.
DAYS_PER_MONTH = 30.0

# Added to the largest value so that it falls inside the last equal-width bin.
BIN_MARGIN = 0.0001

# Column that names the folders of order lines saved by month: the first day of the month.
MONTH_PART = "pay_month"

# Probability given to buyers without a prediction.
DEFAULT_P_OBS = 0.0

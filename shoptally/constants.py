"""Names, word lists and patterns the data and the rules depend on."""

# --- fixed values: sales sheet, positional column names -----------------------
SALES_COLUMNS = (
    "date", "invoice", "staff", "ean", "cat", "lot_number", "sku", "product_name",
    "price", "qty", "disc_percent", "disc_amount", "revenue",
    "cash", "card", "payoo", "banking", "mkt_promo", "vnpay", "trade_in",
    "email", "name", "id", "time", "date_traffic", "event_name", "sub_cat",
)
PAYMENT_COLUMNS = ("cash", "card", "payoo", "banking", "mkt_promo", "vnpay", "trade_in")
REQUIRED_COLUMNS = ("invoice", "ean", "qty", "date", "staff", "sku", "cat", "price", "revenue")

# --- fixed values: stock ledger ------------------------------------------------
INBOUND_TYPES = ("import_po", "import_do", "adjust_in", "return")
OUTBOUND_TYPES = ("adjust_out", "transfer", "sell", "rtv")
MANUAL_TYPES = ("import_po", "import_do", "adjust_in", "adjust_out", "transfer", "rtv")
ORDER_TYPES = ("sell", "return")
FIRST_SEQUENCE_ID = 10_000_000

# --- fixed values: orders and payments ------------------------------------------
ORDER_STATUSES = ("completed", "cancelled")
PAYMENT_METHODS = ("cash", "card", "banking", "vnpay", "voucher")
STORE_TIMEZONE = "Asia/Ho_Chi_Minh"
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"

# --- fixed values: upload sheet --------------------------------------------------
UPLOAD_PRODUCT_COLUMNS = ("ean", "id", "cat", "subcat", "name", "price")
UPLOAD_LEDGER_COLUMNS = ("serial", "quantity", "type", "transaction_id")

# --- fixed values: words that open a column name, by kind; kinds in order of precedence
KIND_WORDS = {
    "date": ("date", "ngay", "day", "created", "updated"),
    "time": ("time", "gio", "hour", "minute", "second"),
    "price": ("price", "unit_price", "unitprice", "đơn_giá", "đơn_gia", "gia", "giá",
              "gia_ban", "giá_bán", "prc"),
    "numeric": ("cash", "card", "vnpay", "payoo", "trade_in", "banking", "mkt_promo", "cost",
                "qty", "quantity", "sl", "disc", "discount", "percent", "fee", "rate", "tax",
                "shipping"),
    "revenue": ("revenue", "total", "total_amount", "total_revenue", "thanh_tien", "thanhtien",
                "doanh_thu", "doanhthu", "tổng_tiền", "tong_tien", "tongtien", "grand_total",
                "subtotal", "tt", "amount"),
    "boolean": ("ins_stt", "tg", "is_", "status", "active"),
    "category": ("cat", "type", "category"),
    "string": ("ean", "inv", "invoice", "inv_no", "inv_number", "order_id", "transaction_id",
               "bill_no", "bill_number", "ma_hoa_don", "serial", "sku", "upc", "code"),
    "phone": ("id", "phone"),
}
# a name holding this word is never a date
NOT_A_DATE_WORD = "traffic"

# --- fixed values: value detectors ---------------------------------------------
BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0")
PHONE_FIRST_DIGITS = ("0", "3", "5", "7", "8", "9")
DETECT_RATIO = 0.9
NUMERIC_NOT_CATEGORY_RATIO = 0.8
CATEGORY_DISTINCT = (2, 33)
BOOLEAN_DISTINCT = 2
PHONE_LENGTH = (9, 11)

# --- fixed values: category order in pick lists (prefix of the upper-cased name, rank)
CATEGORY_RANKS = (("ALL", 0), ("IPH", 1), ("IPA", 2), ("MAC", 2), ("WAT", 2), ("A", 4))
LETTER_RANK, OTHER_RANK = 3, 5

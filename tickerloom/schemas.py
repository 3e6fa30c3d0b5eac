"""Table types. Readers always take one of these; nothing is inferred."""

MONEY = "decimal(18,8)"

BARS = "Date date, Ticker string, Open double, High double, Low double, Close double, Volume bigint"
BAR_FIELDS = "Open", "High", "Low", "Close", "Volume"
BARS_WITH_CHANGE = BARS + ", percentage_change double"
BARS_WITH_RSI = BARS + ", RSI double"
RSI_SUMMARY_CSV = (
    "Ticker string, Total bigint, Overbought bigint, Oversold bigint, `Overbought%` double, `Oversold%` double"
)
CRYPTO_PRICE_CSV = "ticker string, current_price string, fiat_currency string"
NEWS_CSV = "Ticker string, Title string, Source string, date_time string"
USERS = "user_id bigint, name string, email string, phone string, status string"
CRYPTO_PRICE = "crypto_price_id bigint, ticker string, current_price string, fiat_currency string"
TRANSACTIONS = (
    "transaction_id decimal(38,0), user_id bigint, crypto_price_id bigint, number_of_coins decimal(18,8), "
    "amount decimal(15,8), cost decimal(15,2), transaction_type string, created_at timestamp"
)
WALLET = "user_id bigint, amount string"
P2P_ORDERS = (
    "order_id bigint, user_id bigint, ticker string, price decimal(15,8), payment_mode string, status string, "
    "created_at timestamp, transaction_id decimal(38,0)"
)

# Fixed values of the ENUM columns.
TRANSACTION_TYPES = "buy", "sell", "p2p-buy", "p2p-sell"
PAYMENT_MODES = "Wallet", "Bank"

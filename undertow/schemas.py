"""Fixed schemas and value maps."""

from pyspark.sql import types as T

_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


SENTIMENT = _struct(label=_S, score=_D)

NESTED_COMMENT = _struct(
    id=_S, author=_S, body=_S, score=_L, created_utc=_L, created_at=_S, sentiment=SENTIMENT
)

NESTED_POST = _struct(
    subreddit=_S, id=_S, title=_S, url=_S, score=_L, text=_S, created_utc=_L, created_at=_S, num_comments=_L,
    comments=T.ArrayType(NESTED_COMMENT),
)

FLAT_POST = _struct(
    id=_S, created_utc=_D, title=_S, selftext=_S, score=_L, num_comments=_L, author=_S, upvote_ratio=_D, url=_S,
    is_self=T.BooleanType(), is_video=T.BooleanType(), over_18=T.BooleanType(), spoiler=T.BooleanType(),
    stickied=T.BooleanType(), locked=T.BooleanType(), is_original_content=T.BooleanType(), gilded=_L, all_awardings_count=_L,
    total_awards_received=_L, subreddit=_S,
)

PRICE_FILE = _struct(snapped_at=_TS, price=_D, market_cap=_D, total_volume=_D)

# Defaults of missing fields in a flat post.
FLAT_POST_DEFAULTS = {
    "id": "", "title": "", "selftext": "", "author": "", "url": "", "score": 0, "num_comments": 0,
    "upvote_ratio": 0.5, "gilded": 0, "all_awardings_count": 0, "total_awards_received": 0, "is_self": True, "is_video": False,
    "is_original_content": False, "over_18": False, "spoiler": False, "stickied": False, "locked": False,
}

# Word lists of the keyword and lexicon operators.
FEAR_WORDS = ["crash", "dump", "bear", "fear", "panic", "sell", "drop", "fall"]
GREED_WORDS = ["moon", "pump", "bull", "buy", "hodl", "diamond", "rocket", "lambo"]
UNCERTAINTY_WORDS = ["maybe", "perhaps", "uncertain", "confused", "doubt"]
BULLISH_WORDS = ["moon", "bull", "buy", "hodl", "pump", "up", "rise", "gain"]
BEARISH_WORDS = ["dump", "crash", "bear", "sell", "down", "fall", "drop", "loss"]
POSITIVE_WORDS = [
    "good", "great", "excellent", "amazing", "awesome", "love", "buy", "bullish", "moon", "pump", "up", "gain",
    "profit", "hodl",
]
NEGATIVE_WORDS = [
    "bad", "terrible", "awful", "hate", "sell", "bearish", "dump", "crash", "down", "loss", "drop", "fear",
]

# Names whose slug is not found by rule (all others: lower case).
COMMUNITY_SLUGS = {
    "Altcoin": "altcoin", "Bitcoin": "bitcoin", "CryptoCurrency": "cryptocurrency", "DeFi": "defi",
    "Ripple": "ripple", "Tronix": "tronix", "XRP": "xrp",
}

# The coin a community talks about; everything else talks about the default.
COMMUNITY_COIN = {
    "bitcoin": "bitcoin", "ethereum": "ethereum", "cardano": "cardano", "solana": "solana", "dogecoin": "dogecoin",
    "ripple": "ripple", "xrp": "ripple", "binance": "binancecoin", "tronix": "tron", "defi": "defi",
}
DEFAULT_COIN = "bitcoin"

# Price file prefix -> symbol -> display name.
PRICE_SYMBOLS = {"btc": "BTC", "eth": "ETH", "ada": "ADA", "sol": "SOL", "xrp": "XRP", "bnb": "BNB", "ltc": "LTC"}
PRICE_NAMES = {
    "BTC": "Bitcoin", "ETH": "Ethereum", "ADA": "Cardano", "SOL": "Solana", "XRP": "XRP", "BNB": "Binance Coin",
    "LTC": "Litecoin",
}

"""String, hash and date expressions.  Everything here is a Catalyst expression over a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SPARSE_BUCKETS, STOPWORDS

Text = Column | str

_TERM = r"([a-z0-9_/\-]+|[\x{4e00}-\x{9fff}]{2,})"
_CJK = r"[\x{4e00}-\x{9fff}]"
_LONG_RUN = r"^[\x{4e00}-\x{9fff}]{4,}$"
_EDGES = r"(?U)^\s+|\s+$"


def _col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Text) -> Column:
    """Without white space (in Unicode's sense) at either end."""
    return F.regexp_replace(_col(c), _EDGES, "")


def normalize_text(c: Text) -> Column:
    """Line feeds only, at most one blank line in a row, stripped."""
    lines = F.regexp_replace(_col(c), "\r\n?", "\n")
    return strip(F.regexp_replace(lines, "\n{3,}", "\n\n"))


def clean_text(c: Text) -> Column:
    """White space collapsed to single blanks; '' for null."""
    return strip(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)\s+", " "))


def slugify(c: Text, default: str = "customer_support") -> Column:
    slug = F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_")
    slug = F.regexp_replace(slug, "^_+|_+$", "")
    return F.when(slug == "", F.lit(default)).otherwise(slug)


def path_slug(c: Text, max_length: int = 80, default: str = "default") -> Column:
    slug = F.regexp_replace(F.regexp_replace(strip(c), "[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(slug == "", F.lit(default)).otherwise(F.substring(slug, 1, max_length))


def tokenize(c: Text) -> Column:
    """Lower-case terms in text order: Latin runs and CJK runs; long CJK runs also give their bigrams.

    Only texts with CJK characters have words that are no terms or runs to spread.
    """
    runs = F.regexp_extract_all(F.lower(_col(c)), F.lit(_TERM), F.lit(1))
    kept = F.filter(runs, lambda t: ~t.isin(*STOPWORDS))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: t.substr(i, F.lit(2)))
    spread = F.transform(kept, lambda t: F.when(t.rlike(_LONG_RUN), F.concat(F.array(t), pairs(t))).otherwise(F.array(t)))
    return F.when(_col(c).rlike(_CJK), F.flatten(spread)).otherwise(runs)


def split_values(c: Text) -> Column:
    """Distinct values of a list separated by commas, semicolons (ASCII or full width) or white space."""
    return F.array_distinct(F.filter(F.split(F.coalesce(_col(c), F.lit("")), r"(?U)[,，;；\s]+"), lambda v: v != ""))


def sortable_day(c: Text, default: int) -> Column:
    """A date as yyyymmdd: ISO dates, else the first eight digits; ``default`` where there are fewer."""
    digits = F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) >= 8, F.substring(digits, 1, 8).cast("int")).otherwise(F.lit(default))


def content_hash(c: Text, identity: Text, dimensions: int) -> Column:
    nul = F.unhex(F.lit("00"))
    parts = [_col(identity).cast("binary"), nul, F.lit(str(dimensions)).cast("binary"), nul, _col(c).cast("binary")]
    return F.sha2(F.concat(*parts), 256)


def embedding_identity(provider: Text, model: Text) -> Column:
    return F.concat(F.lower(strip(provider)), F.lit(":"), strip(model))


def scope_key(scopes: Text) -> Column:
    return F.array_join(F.array_sort(F.filter(_col(scopes), lambda s: strip(s) != "")), "\x1f")


def token_count(c: Text) -> Column:
    """Half the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(_col(c)) / 2)).cast("int")


# ------------------------------------------------------------------ hashed vectors


def _hex_number(digest: Column, start: int, size: int) -> Column:
    return F.conv(F.substring(digest, start, size), 16, 10).cast("long")


def hash_slot(term: Text, dims: int) -> Column:
    """(idx, sign) of a term in a hashed embedding."""
    digest = F.sha2(_col(term), 256)
    sign = F.when(_hex_number(digest, 9, 2) % 2 == 0, 1).otherwise(-1)
    return F.struct((_hex_number(digest, 1, 8) % dims).cast("int").alias("idx"), sign.alias("sign"))


def sparse_bucket(term: Text) -> Column:
    """First 64 bits of the term's digest modulo the number of buckets, without leaving 64-bit arithmetic."""
    digest = F.sha2(_col(term), 256)
    high, low = _hex_number(digest, 1, 8), _hex_number(digest, 9, 8)
    return ((high % SPARSE_BUCKETS) * 2 + low) % SPARSE_BUCKETS


# ------------------------------------------------------------------ sentences, answers


def split_sentences(c: Text) -> Column:
    """Stripped sentences; headings are left out; an ASCII full stop ends no sentence."""
    bare = F.regexp_replace(_col(c), r"(?m)^#+\s+.*$", "")
    return F.filter(F.transform(F.split(bare, "(?<=[。！？!?])"), strip), lambda s: s != "")


def citation_ids(c: Text) -> Column:
    """Distinct ids of citations such as [E1], in lexicographic order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(c), F.lit(r"\[(E\d+)\]"), F.lit(1))))


# Patterns and points of the rules that score a sentence against a query.
CODE_TERM, CODE_POINTS = "[a-z0-9]", 6
TIME_QUERY = "多久|几天|到账|时间"
TIME_STRONG, TIME_STRONG_POINTS = r"通常|一般|为\s*\d|[0-9０-９]+\s*到\s*[0-9０-９]+", 7
TIME_WEAK, TIME_WEAK_POINTS = "工作日|到账|时间", 3
TIME_EXCESS, TIME_EXCESS_POINTS = "超过", -2
TOPIC_RULES = (
    ("sku|SKU|无理由|退货|退款|支持", "SKU-A17|不支持|支持|无理由|质量问题", 4),
    ("SKU-A17", "SKU-A17", 8),
    (r"预售|48\s*小时|催单", r"预售|48\s*小时|催单|承诺", 4),
    ("积分|提现|转赠", "积分|提现|转赠|兑换", 4),
)
OUT_OF_DOMAIN = "天气|气温|下雨|空气质量|股票|股价|汇率|彩票|新闻|热搜|比赛|比分"
IN_DOMAIN = (
    "订单|退款|退货|换货|物流|快递|发货|配送|签收|发票|税号|优惠券|积分|会员|保修|维修|召回|商品|商家|客服|账号|登录|验证码|地址"
    "|SKU|COD|CoD|invoice|refund|return|delivery|warranty|account|login"
)


def sentence_score(sentence: Text, query: Text, query_terms: Text) -> Column:
    """Shared terms plus the points of the rules that the query and the sentence both meet."""
    s, q, terms = _col(sentence), _col(query), _col(query_terms)
    points = lambda condition, n: F.when(condition, F.lit(float(n))).otherwise(F.lit(0.0))
    shared = F.size(F.array_intersect(F.array_distinct(terms), tokenize(s))).cast("double")
    code = F.exists(F.filter(terms, lambda t: t.rlike(CODE_TERM)), lambda t: F.lower(s).contains(t))
    strong, weak = s.rlike(TIME_STRONG), s.rlike(TIME_WEAK)
    timed = points(strong, TIME_STRONG_POINTS) + points(~strong & weak, TIME_WEAK_POINTS)
    timed = timed + points(s.contains(TIME_EXCESS), TIME_EXCESS_POINTS)
    score = shared + points(code, CODE_POINTS) + F.when(q.rlike(TIME_QUERY), timed).otherwise(F.lit(0.0))
    for asked, told, n in TOPIC_RULES:
        score = score + points(q.rlike(asked) & s.rlike(told), n)
    return score


def is_out_of_domain(query: Text) -> Column:
    q = _col(query)
    return q.rlike(f"(?i){OUT_OF_DOMAIN}") & ~q.rlike(f"(?i){IN_DOMAIN}")

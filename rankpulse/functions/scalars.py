"""Column expressions: text, dates, scores. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P

CJK = r"[\x{4e00}-\x{9fff}]"


def _quoted(words) -> str:
    return "|".join(re.escape(w) for w in words)


def _class(chars: set[str]) -> str:
    """A class that holds the characters: single ones of Latin-1 and a range of all others, which Java looks through fast."""
    near, far = sorted(ord(c) for c in chars if ord(c) < 256), sorted(ord(c) for c in chars if ord(c) >= 256)
    return "[" + "".join(f"\\x{{{c:x}}}" for c in near) + (f"\\x{{{far[0]:x}}}-\\x{{{far[-1]:x}}}" if far else "") + "]"


def _any_of(words) -> str:
    """A pattern of any of the words. Places where none begins are passed over by classes of first and second characters, words of one first character stand together."""
    if "" in words:
        return _quoted(words)
    rest: dict[str, list[str]] = {}
    for w in words:
        rest.setdefault(w[0], []).append(w[1:])
    ahead = _class(set(rest)) + (_class({r[0] for rs in rest.values() for r in rs}) if all(map(all, rest.values())) else "")
    each = {c: f"{re.escape(c)}(?:{_quoted(rs)})" for c, rs in rest.items()}
    near, far = [p for c, p in each.items() if ord(c) < 256], [p for c, p in each.items() if ord(c) >= 256]
    parts = near + ([f"(?={_class({c for c in rest if ord(c) >= 256})})(?:{'|'.join(far)})"] if far else [])
    return f"(?={ahead})(?:{'|'.join(parts)})"


def bound(value: Column, f) -> Column:
    """f(value), with value worked out once however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def contains_any(col: Column, words, fold: bool = False) -> Column:
    """Whether any word is a substring; fold: without regard to case. Null is false."""
    if not words:
        return F.lit(False)
    c = F.lower(col) if fold else col
    return F.coalesce(c.rlike(_any_of([w.lower() for w in words] if fold else words)), F.lit(False))


def keyword_match(col: Column, words) -> Column:
    """Keywords of ASCII letters alone need ASCII word boundaries, others are substrings; case is ignored, blanks never match."""
    words = [w.strip().lower() for w in words if w.strip()]
    bounded = [w for w in words if re.fullmatch("[a-z]+", w)]
    other = [w for w in words if w not in bounded]
    low = F.lower(F.coalesce(col, F.lit("")))
    hit = F.lit(False)
    if bounded:
        hit = hit | low.rlike(f"(?<![a-z0-9_]){_any_of(bounded)}(?![a-z0-9_])")
    return hit | low.rlike(_any_of(other)) if other else hit


def normalize_platform(col: Column) -> Column:
    up = F.upper(F.trim(F.coalesce(col, F.lit(""))))
    return F.when(up.contains("IOS"), "iOS").when(up.contains("ANDROID"), "Android").otherwise(up)


def game_names(col: Column) -> Column:
    """Distinct names in 《》; else the first in 「」."""
    names = F.array_distinct(F.regexp_extract_all(col, F.lit("《([^》]+)》"), F.lit(1)))
    other = F.slice(F.regexp_extract_all(col, F.lit("「([^」]+)」"), F.lit(1)), 1, 1)
    return F.when(F.size(names) > 0, names).otherwise(other)


def topic_words(col: Column, min_cjk: int = 2, min_ascii: int = 3, noise=P.NOISE_WORDS) -> Column:
    """Runs of CJK and, lower-cased, of ASCII letters, long enough and no noise; distinct."""
    cjk = F.regexp_extract_all(col, F.lit(f"({CJK}{{{min_cjk},}})"), F.lit(1))
    word = F.transform(F.filter(F.regexp_extract_all(col, F.lit("([A-Za-z]+)"), F.lit(1)), lambda x: F.length(x) >= min_ascii), F.lower)
    return F.array_except(F.array_union(cjk, word), F.array(*map(F.lit, noise)))


def dedup_tokens(col: Column) -> Column:
    """Names and long topic words of a headline without its usual prefixes, lower-cased."""
    for prefix in P.TITLE_PREFIXES:
        col = F.replace(col, F.lit(prefix), F.lit(""))
    names = F.array_distinct(F.regexp_extract_all(col, F.lit("《([^》]+)》"), F.lit(1)))
    return F.array_distinct(F.transform(F.array_union(names, topic_words(col, 4, 4)), F.lower))


def similarity_tokens(col: Column) -> Column:
    """ASCII words of two letters or more and bigrams of the CJK characters in order, lower-cased, no noise."""
    low = F.lower(F.coalesce(col, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("([a-z]{2,})"), F.lit(1))
    cjk = F.regexp_replace(low, f"[^\\x{{4e00}}-\\x{{9fff}}]", "")
    pairs = F.when(F.length(cjk) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(cjk) - 1)), lambda i: F.substr(cjk, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.array_except(F.array_union(words, pairs), F.array(*map(F.lit, P.STORY_NOISE)))


def named_entities(col: Column) -> Column:
    """Capitalised words but the usual ones, and known companies."""
    words = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit("([A-Z][a-z]{2,}(?:[A-Z][a-z]+)*)"), F.lit(1))
    known = F.filter(F.array(*map(F.lit, P.ENTITY_COMPANIES)), lambda c: F.coalesce(col, F.lit("")).contains(c))
    return F.array_union(F.array_except(words, F.array(*map(F.lit, P.ENTITY_STOP))), known)


def fact_count(body: Column) -> Column:
    """Numbers, names in 《》 and known companies, 20 at most."""
    b = F.coalesce(body, F.lit(""))
    known = F.when(contains_any(b, P.COMPANIES), F.size(F.filter(F.array(*map(F.lit, P.COMPANIES)), lambda c: b.contains(c)))).otherwise(0)
    return F.least(F.lit(20), F.regexp_count(b, F.lit(r"[0-9]+\.?[0-9]*")) + F.regexp_count(b, F.lit("《[^》]+》")) + known)


def freshness(body: Column, year: int) -> Column:
    """The first time mark of the ordered list; else a month; else a sign of an earlier year; else none."""
    b = F.coalesce(body, F.lit(""))
    # all that is looked for has one of these characters
    out = F.when(~contains_any(b, tuple({m[0] for m, _ in P.FRESH_MARKS} | set("去年月"))), "未标注")
    for mark, label in P.FRESH_MARKS:
        out = out.when(b.contains(mark), label)
    month, old = F.regexp_extract(b, "([0-9]+)月", 1), F.regexp_extract(b, r"(?:^|[^0-9])([0-9]{4})\s*年", 1)
    return out.when(month != "", F.concat(month, F.lit("月"))).when(b.contains("去年"), "去年或更早").when(F.try_to_number(old, F.lit("9999")) < year, "去年或更早").otherwise("未标注")


def is_digest(body: Column) -> Column:
    return contains_any(body, P.DIGEST_WORDS)


def signal_score(body: Column, year: int) -> Column:
    """40, plus and minus points for length, facts, freshness and digests, within 0..100. Each sign is taken once a body."""

    def points(s: Column) -> Column:
        n, facts, fresh = s["n"], s["facts"], s["fresh"]
        total = (
            40 + F.when(n <= 100, -15).when(n > 500, 5).otherwise(0) + F.when(n == 0, -10).when(facts >= 5, 10).when(facts >= 2, 5).when(facts == 0, -10).otherwise(0)
            + F.when(s["digest"], -10).otherwise(0) + F.when(fresh.isin("今日", "昨日"), 10).when(fresh.isin("上周", "上月", "去年或更早"), -10).otherwise(0)
        )
        return F.greatest(F.lit(0), F.least(F.lit(100), total))

    signs = F.struct(F.length(F.coalesce(body, F.lit(""))).alias("n"), fact_count(body).alias("facts"), freshness(body, year).alias("fresh"), is_digest(body).alias("digest"))
    return F.get(F.transform(F.array(signs), points), 0)


def fuse(signal: Column, score: Column) -> Column:
    """3 parts signal and 7 parts score, half to even; at most 59 where a weak signal meets a score over 60."""
    fused = F.bround(((3 * signal + 7 * score) / 10).cast("decimal(6,1)"), 0).cast("int")
    return F.when((signal < 20) & (score > 60), F.least(fused, F.lit(59))).otherwise(fused)


def valid_label(col: Column, allowed) -> Column:
    return F.when(col.isin(*allowed), col).otherwise("")


def topic_key(headline: Column) -> Column:
    """The first name in 《》, else the first 20 characters without a video mark."""
    name = F.regexp_extract(headline, "《([^》]+)》", 1)
    return F.when(name != "", F.trim(name)).otherwise(F.substring(F.trim(F.regexp_replace(headline, r"\[B站[^\]]+\]", "")), 1, 20))


def url_canonical(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, "[?#].*$", ""))


def url_domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#:]+)", 1)), "^www[.]", "")


def url_date(url: Column) -> Column:
    """The date in a URL as text, or its month: /yyyymm/, /yyyy/mmdd/, /yyyy/mm/number, /yyyymmdd, in this order; else empty."""
    part = lambda p, *at: F.concat_ws("-", *(F.regexp_extract(url, p, i) for i in at))
    y = "/(20[2-9][0-9])"
    month, day, article, compact = f"{y}([0-9]{{2}})/", f"{y}/([0-9]{{2}})([0-9]{{2}})/", f"{y}/([0-9]{{2}})/[0-9]{{4,}}", f"{y}([0-9]{{2}})([0-9]{{2}})[^0-9]"
    return F.when(url.rlike(month), part(month, 1, 2)).when(url.rlike(day), part(day, 1, 2, 3)).when(url.rlike(article), part(article, 1, 2)).when(url.rlike(compact), part(compact, 1, 2, 3)).otherwise("")


def within_days(text: Column, as_of: Column, n: int = 7) -> Column:
    """Whether a date text lies 0..n days before as_of. A month alone counts in its own month, else by its first day; bad dates don't."""
    month = text.rlike("^[0-9]{4}-[0-9]{2}$")
    day = F.try_to_date(F.when(month, F.concat(text, F.lit("-01"))).when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(text, 1, 10)))
    return F.coalesce((month & (F.date_format(as_of, "yyyy-MM") == text)) | F.datediff(as_of, day).between(0, n), F.lit(False))


_FULL, _SHORT = r"([0-9]{4})[-/年]([0-9]{1,2})[-/月]([0-9]{1,2})", r"([0-9]{1,2})[-/月]([0-9]{1,2})"


def _full_date(text: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", *(F.lpad(F.regexp_extract(text, _FULL, i), 4 if i == 1 else 2, "0") for i in (1, 2, 3))))


def _short_date(text: Column, year: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.date_format(year, "yyyy"), *(F.lpad(F.regexp_extract(text, _SHORT, i), 2, "0") for i in (1, 2))))


def _short_age(text: Column, as_of: Column) -> Column:
    """Age of a month and day of this year, or of the last one if that is to come."""
    this = _short_date(text, as_of)
    return F.datediff(as_of, F.when(this > as_of, _short_date(text, F.add_months(as_of, -12))).otherwise(this))


def age_days(text: Column, as_of: Column) -> Column:
    """Age in days of relative words or of a date; a month and day alone tells only ages over 90. Null if neither is there."""
    short = _short_age(text, as_of)
    return (
        F.when(text.rlike(r"^[0-9]+\s*小时前"), 0).when(text.rlike(r"^[0-9]+\s*天前"), F.regexp_extract(text, r"^([0-9]+)\s*天前", 1).try_cast("int"))
        .when(text.contains("昨天"), 1).when(text.contains("前天"), 2).when(text.rlike(_FULL), F.datediff(as_of, _full_date(text)))
        .when(text.rlike(_SHORT) & (short > 90), short)
    )


def title_age_days(title: Column, as_of: Column) -> Column:
    """Age by a date in a title, with or without its year."""
    return F.coalesce(F.when(title.rlike(_FULL), F.datediff(as_of, _full_date(title))), F.when(title.rlike(_SHORT), _short_age(title, as_of)))


def text_date(text: Column, as_of: Column) -> Column:
    """y-m-d in a text, else month and day of the current year."""
    return F.when(text.rlike(_FULL), _full_date(text)).when(text.rlike(_SHORT), _short_date(text, as_of))


def normalize_keyword(raw: Column) -> Column:
    """Without a heat mark in front; over 20 characters cut there and back to a boundary."""
    clean = F.regexp_replace(raw, r"^(热|爆|沸|新)\s*", "")
    cut = F.substring(clean, 1, 20)
    for mark in ("，", "。", " "):
        cut = F.regexp_replace(cut, f"{mark}[^{mark}]*$", "")
    return F.trim(F.when(F.length(clean) > 20, cut).otherwise(clean))


def clean_discussion(title: Column) -> Column:
    """A title of a discussion site without the site's name and words of its pages."""
    t = F.regexp_replace(F.trim(title), r"(?i)\s*[-|_｜]\s*.*知乎.*$", "")
    t = F.regexp_replace(t, r"(?iU)\b(知乎|回答|文章)\b", "")
    return F.regexp_replace(t, r"^[ \-|_｜]+|[ \-|_｜]+$", "")


def is_relevant(col: Column, yes=P.RELEVANT_WORDS, no=P.IRRELEVANT_WORDS) -> Column:
    return ~contains_any(col, no) & contains_any(col, yes, fold=True)


def is_compact(keyword: Column, source: Column) -> Column:
    k = F.trim(F.coalesce(keyword, F.lit("")))
    fine = (k != "") & (F.length(k) <= 14) & (F.regexp_count(k, F.lit("[0-9]")) < 4) & ~k.rlike(r"[，。！？；：()（）\[\]【】/\\]") & (F.regexp_count(k, F.lit(" ")) < 3)
    return (source == "curated") | fine


def is_search_page(url: Column, hosts=("so.com", "www.so.com")) -> Column:
    host = F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]*)", 1))
    path = F.lower(F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    return F.coalesce((url == "") | (host.isin(*hosts) & ((path == "") | path.startswith("/s"))), F.lit(True))


def is_domain_headline(col: Column, yes=P.GAMING_SIGNALS, no=P.FOREIGN_CONTEXT) -> Column:
    """Denied unless a signal word stands in it, or a name in 《》 without a foreign context."""
    return F.coalesce(contains_any(col, yes, fold=True) | (col.contains("《") & col.contains("》") & ~contains_any(col, no)), F.lit(False))


def _hits(low: Column, words) -> Column:
    words = [w.lower() for w in words]
    return F.when(contains_any(low, words), F.size(F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w)))).otherwise(0)


def hot_score(title: Column, snippet: Column, url: Column, relevant=P.RELEVANT_WORDS, platform=P.PLATFORM_WORDS, business=P.BUSINESS_WORDS, track=P.HOT_TRACK_WORDS) -> Column:
    """-999 for what is empty, a search page, irrelevant, recruiting or of low value; else 2 a platform word, 3 a business word, 2 for a topic."""
    text = F.trim(F.concat_ws(" ", F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(snippet, F.lit("")))))

    def judged(t: Column, low: Column) -> Column:
        points = 2 * _hits(low, platform) + 3 * _hits(low, business) + F.when(contains_any(t, track), 2).otherwise(0)
        bad = (t == "") | is_search_page(url) | ~contains_any(low, [w.lower() for w in relevant]) | contains_any(low, P.RECRUITING_WORDS) | contains_any(low, P.LOW_VALUE_WORDS) | contains_any(t, P.IRRELEVANT_WORDS)
        return F.when(bad, -999).otherwise(bound(points, lambda p: F.when(p == 0, -999).otherwise(p)))

    # a whole text is put together and lower-cased once, not for each word
    return bound(text, lambda t: bound(F.lower(t), lambda low: judged(t, low)))


def keyword_weight(rank: Column, clicks: Column) -> Column:
    """max(0.1, 1 - rank / 100) + 0.2 a click, two places."""
    return (F.greatest(F.lit(10), 100 - rank) + 20 * F.coalesce(clicks, F.lit(0))).cast("decimal(10,2)") / F.lit(100)


def downloads_number(text: Column) -> Column:
    """The number in front of a download text; before 万 it counts ten thousands."""
    t = F.trim(text)
    many, few = F.regexp_extract(t, r"^([0-9.]+)\s*万", 1).try_cast("decimal(18,4)"), F.regexp_extract(t, r"^([0-9]+)", 1).try_cast("long")
    return F.coalesce((many * 10000).cast("long"), few, F.lit(0).cast("long"))


def tag_summary(tags: Column, n: int = 3) -> Column:
    """The first n tags, whichever way they are parted."""
    said = F.array_join(F.slice(F.filter(F.transform(F.split(tags, r"[,|]"), lambda x: F.trim(x)), lambda x: x != ""), 1, n), "、")
    return F.when(F.coalesce(said, F.lit("")) == "", "新游").otherwise(F.concat(said, F.lit("游戏")))


def source_canonical(col: Column) -> Column:
    low = F.lower(F.trim(col))
    out = F.when(low.isin(*P.REMOVED_SOURCES), F.lit(None))
    for alias, name in P.SOURCE_ALIASES.items():
        out = out.when(low == alias, name)
    for name in P.SOURCE_ORDER:  # known names in any case
        out = out.when(low == name.lower(), name)
    return out.otherwise(F.trim(col))


def _lookup(col: Column, of: dict, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[col], default if isinstance(default, Column) else F.lit(default))


def source_order(col: Column) -> Column:
    return _lookup(col, P.SOURCE_ORDER, 99)


def source_weight(col: Column) -> Column:
    return _lookup(col, P.SOURCE_WEIGHT, 0)


def source_label(col: Column) -> Column:
    return _lookup(col, P.SOURCE_LABEL, col)


def event_type(text: Column) -> Column:
    return (
        F.when(text.rlike("首发|上线"), "首发").when(text.rlike("预|测试"), "预约/测试").when(text.rlike("更新|版本"), "版本更新")
        .when(F.lower(text).rlike("demo|试玩"), "Demo").otherwise("新游")
    )


def excerpt(raw: Column, n: int = 200) -> Column:
    """Text without tags, entities and runs of white space, n characters at most."""
    t = F.regexp_replace(F.regexp_replace(raw, "<[^>]*>", " "), "&[a-zA-Z#0-9]+;", " ")
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, n)


def rfc2822_date(col: Column) -> Column:
    """An RFC 2822 or ISO date text as a date."""
    iso = F.try_to_date(F.regexp_extract(col, "^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1))
    return F.coalesce(iso, F.try_to_date(F.regexp_extract(col, "([0-9]{1,2} [A-Z][a-z]{2} [0-9]{4})", 1), "d MMM yyyy"))


def expand_question(keyword: Column, year: int) -> Column:
    """A question out of a short keyword; questions and phrases of over 12 characters stay."""
    k = F.trim(keyword)
    short = F.concat(F.lit('游戏行业 "'), k, F.lit(f'" {year}年最新动态与发展趋势'))
    return F.when((k == "") | k.contains("？") | k.contains("?") | (F.length(k) > 12), k).when(F.length(k) <= 4, short).otherwise(F.concat(F.lit('游戏行业 "'), k, F.lit('" — 最新动态与行业影响')))


def query_variants(keyword: Column, date: Column) -> Column:
    said = [F.concat(keyword, F.lit(s)) for s in (" 今天", " 最新", " 游戏 今日", " 游戏 行业 今天")]
    return F.array(*said, F.concat_ws(" 游戏 行业 ", keyword, date.cast("string")))


def headline_links(text: Column) -> Column:
    """URLs of the markdown links of a published text."""
    return F.regexp_extract_all(text, F.lit(r"\]\((https?://[^)]+)\)"), F.lit(1))


def clean_headline(col: Column) -> Column:
    return F.regexp_replace(col, r"^(游戏资讯|行业活动|行业分析)\s*", "")


#: Parts of URLs that no article image has.
IMAGE_SKIP = (
    "1x1", "pixel", "tracking", "favicon", "beacon", "/logo.", "/logo-", "logo.png", "logo.jpg", "logo.svg", "logo.webp", "/icon.", "icon.png",
    "icon.jpg", "apple-touch-icon", "avatar", "qr.png", "qr.jpg", "qrcode", "qr_code", "qr-code", "banner-ad", "banner_ad", "/ad.", "/ad-", "广告",
    "二维码", "analytics", "spacer",
)


def valid_image(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?://") & ~contains_any(F.lower(url), IMAGE_SKIP), F.lit(False))


def dimension(text: Column) -> Column:
    """A width or height such as 100, 100px or 50%."""
    return F.regexp_replace(F.trim(text), "(px|%)+$", "").try_cast("double").cast("int")


def fidelity(up: Column, down: Column, pos: Column, neg: Column, track: Column) -> Column:
    """Weighted sum of agreement, concentration, topic and label signals, three places. Any label counts as one, only clear ones agree or disagree."""
    d = lambda x: F.lit(x).cast("decimal(6,4)")
    net, total = up - down, up + down
    has_pos, has_neg = pos.isin(*P.CLEAR_POS_LABELS), neg.isin(*P.CLEAR_NEG_LABELS)
    agree = (
        F.when(has_pos & (net > 0), d("1.0")).when(has_neg & (net < 0), d("0.85")).when((has_pos & (net < 0)) | (has_neg & (net > 0)), d("0.40"))
        .when((has_pos | has_neg) & (net == 0), d("0.25")).otherwise(d("0.15"))
    )
    depth = F.when(total >= 5, d("1.0")).when(total >= 3, d("0.75")).when(total == 2, d("0.40")).when(total == 1, d("0.15")).otherwise(d("0"))
    share = F.when(total > 0, (F.abs(net) / total).cast("decimal(12,8)")).otherwise(F.lit(0).cast("decimal(12,8)"))
    focus = depth * (F.lit("0.5").cast("decimal(3,1)") + F.lit("0.5").cast("decimal(3,1)") * share)
    return F.round(F.lit("0.40").cast("decimal(3,2)") * agree + F.lit("0.30").cast("decimal(3,2)") * focus + F.when(track, d("0.20")).otherwise(d("0")) + F.when((F.trim(pos) != "") | (F.trim(neg) != ""), d("0.10")).otherwise(d("0")), 3).cast("decimal(4,3)")

"""Rules on requests, replies, names and boxes as column expressions and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import line_similarity

# -- replies and addresses --------------------------------------------------------------------------------------------


def matches(a: Column, b: Column, least: float) -> Column:
    """Whether two lines are the same but for blanks around them, or at least so similar; 1 asks for equal ones."""
    a, b = F.btrim(a), F.btrim(b)
    return (a == b) if least >= 1 else (a == b) | (line_similarity(a, b) >= least)


def percent_decode(text: Column) -> Column:
    """Plus signs are blanks; escapes that aren't two hexadecimal digits stay as they are."""
    return F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def percent_encode(text: Column) -> Column:
    """All bytes but letters, digits and -_.~ as escapes."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def allowed_path(path: Column, roots: list[str]) -> Column:
    """The path below an allowed root, relative ones below the first; null for one that climbs or lies elsewhere."""
    absolute = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(roots[0] + "/"), path))
    parts = F.filter(F.split(absolute, "/"), lambda x: (x != "") & (x != "."))
    clean = F.concat(F.lit("/"), F.array_join(parts, "/"))
    inside = F.lit(False)
    for r in roots:
        inside = inside | (clean == r) | clean.startswith(r + "/")
    return F.when(~F.exists(F.split(path, "/"), lambda x: x == "..") & inside, clean)


def hosted_reply(body: Column) -> tuple[Column, Column, Column]:
    """Text, token count and error message of a hosted model's reply: an error first, else the first part's text."""
    get = lambda p: F.get_json_object(body, p)
    failed = F.when(get("$.error").isNotNull(), F.coalesce(get("$.error.message"), F.lit("unknown error")))
    text = F.when(failed.isNull(), get("$.candidates[0].content.parts[0].text"))
    count = F.when(text.isNotNull(), get("$.usageMetadata.totalTokenCount").cast("long"))
    return text, count, F.coalesce(failed, F.when(text.isNull(), F.lit("no text in the reply")))


def classified(status: Column, body: Column) -> Column:
    """(kind, message, retry_after): what a failed call means; a message is the body's own, else its first 300 characters."""
    message = F.coalesce(F.get_json_object(body, "$.error.message"), F.substring(body, 1, 300))
    kind = F.when(status.isin(401, 403), "authentication_failed").when(status == 429, "rate_limited").otherwise("api_error")
    return F.struct(kind.alias("kind"), F.when(status != 429, message).alias("message"), F.when(status == 429, F.lit(60)).alias("retry_after"))


def usage_of(body: Column) -> Column:
    """(input, output, thinking, version): the counts of a reply, missing ones zero; null without any."""
    count = lambda k: F.coalesce(F.get_json_object(body, f"$.usageMetadata.{k}").cast("long"), F.lit(0))
    own = F.struct(count("promptTokenCount").alias("input"), count("candidatesTokenCount").alias("output"), count("thoughtsTokenCount").alias("thinking"), F.get_json_object(body, "$.modelVersion").alias("version"))
    return F.when(F.get_json_object(body, "$.usageMetadata").isNotNull(), own)


def name_version(name: Column) -> Column:
    """The numbers behind a model name's family, as an array; null for names without."""
    part = F.get(F.split(name, "-"), 1)
    return F.when(part.rlike(r"^\d+(\.\d+)*$"), F.transform(F.split(part, r"\."), lambda x: x.cast("int")))


def newest_first(models: DataFrame, by: list[str], name: str) -> DataFrame:
    """models with place, from 1: names without a version before all others, then the highest version, then by name."""
    v = F.transform(F.col("__v"), lambda x: -x)
    # of versions that begin alike the longer one is the higher: an end mark above all negated numbers
    w = Window.partitionBy(*by).orderBy(F.col("__v").isNotNull(), F.concat(v, F.array(F.lit(1))), name)
    return models.withColumn("__v", name_version(F.col(name))).withColumn("place", F.row_number().over(w)).drop("__v")


def source_spec(window: Column, target: Column, url: Column, displays: Column) -> Column:
    """The one source that a request names: window, target, input or displays; none is all displays, two are an error."""
    given = lambda c: F.coalesce(F.btrim(c) != "", F.lit(False))
    chosen = [(given(window), "window"), (given(target), "target"), (given(url), "input"), (F.coalesce(F.size(displays) > 0, F.lit(False)), "displays")]
    n = sum((c.cast("int") for c, _ in chosen), F.lit(0))
    kind = F.coalesce(*[F.when(c, k) for c, k in chosen], F.lit("all_displays"))
    return F.when(n <= 1, kind).otherwise("error")


#: Roles of accessible elements and their granularity; all others are elements.
ROLES = {
    "window": ("frame", "window", "dialog", "application"),
    "pane": ("panel", "scroll pane", "split pane", "layered pane", "filler", "tool bar", "menu bar", "status bar", "page tab", "page tab list", "viewport"),
    "text": ("text", "label", "static", "paragraph"),
}


def role_granularity(role: Column) -> Column:
    return F.when(role.isin(*ROLES["window"]), "window").when(role.isin(*ROLES["pane"]), "pane").when(role.isin(*ROLES["text"]), "text").otherwise("element")


#: Fixed value: bytes for each output pixel of a stack, beside 12 for each pixel of each frame.
POST_BYTES = 192


def stack_bytes(frames: Column, w: Column, h: Column, scale: Column) -> Column:
    """Estimated memory of a stack; every step stops at 2^64 - 1."""
    dec = lambda c: c.cast("decimal(38,0)")
    top = F.lit(str(2**64 - 1)).cast("decimal(38,0)")
    cap = lambda c: F.coalesce(F.least(dec(c), top), top)
    px = cap(F.try_multiply(cap(F.try_multiply(cap(F.try_multiply(dec(F.abs(w)), dec(F.abs(scale)))), dec(F.abs(h)))), dec(F.abs(scale))))
    each = cap(F.try_multiply(cap(F.try_multiply(dec(frames), px)), dec(F.lit(12))))
    return cap(F.try_add(each, cap(F.try_multiply(px, dec(F.lit(POST_BYTES))))))


# -- displays ---------------------------------------------------------------------------------------------------------


def display_name(index: Column, w: Column, h: Column, primary: Column) -> Column:
    """Displays are counted from one in names."""
    return F.concat(F.lit("Display "), (index + 1).cast("string"), F.lit(" ("), w.cast("string"), F.lit("x"), h.cast("string"), F.when(primary, ", Primary").otherwise(""), F.lit(")"))


def display_matches(wanted: Column, w: Column, h: Column, primary: Column, name: Column) -> Column:
    """Whether a display is what a selection's word asks for: a role, a shape or a name."""
    low = F.lower(F.btrim(wanted))
    ratio = F.when(h > 0, w / h).otherwise(F.lit(0.0))
    return F.when(low.isin("primary", "main"), primary).when(low == "portrait", h > w).when(low == "landscape", (w > h) & (ratio < 2)).when(low == "ultrawide", ratio >= 2).otherwise(F.lower(name) == low)


def selected_displays(wanted: DataFrame, displays: DataFrame) -> DataFrame:
    """(id, displays) of the requests (id, words array) that match a display: indexes in the order of the words, each once.
    displays: (index, w, h, primary, name), a handful."""
    each = wanted.select("id", F.posexplode("words").alias("at", "word"))
    met = each.join(F.broadcast(displays), display_matches(F.col("word"), F.col("w"), F.col("h"), F.col("primary"), F.col("name")))
    first = met.groupBy("id", "index").agg(F.min("at").alias("at"))
    return first.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "index"))), lambda x: x["index"]).alias("displays"))


# -- regions by name --------------------------------------------------------------------------------------------------

#: Words for positions, from one.
ORDINALS = (("first", "1st"), ("second", "2nd"), ("third", "3rd"), ("fourth", "4th"), ("fifth", "5th"), ("sixth", "6th"), ("seventh", "7th"), ("eighth", "8th"), ("ninth", "9th"), ("tenth", "10th"))
#: Nouns that name a granularity, in the order in which they are tried.
NOUNS = (("window", "window"), ("pane", "pane"), ("button|icon|menu", "element"), ("label| text", "text"))
LAST, FIRST, MIDDLE = "last|final|rightmost|far right|right side|the right", "leftmost|far left|left side|the left", "middle|center|centre|central"


def ordinal(low: Column) -> Column:
    """A request's position from one: a word for it, else the first number from 1 to 12; null without."""
    word = F.coalesce(*[F.when(low.rlike("|".join(w)), F.lit(i)) for i, w in enumerate(ORDINALS, 1)])
    numbers = F.filter(F.transform(F.regexp_extract_all(low, F.lit(r"(\d+)"), 1), lambda x: x.try_cast("long")), lambda x: x.between(1, 12))
    return F.coalesce(word, F.get(numbers, 0).cast("int"))


def wanted_granularity(low: Column) -> Column:
    return F.coalesce(*[F.when(low.rlike(k), F.lit(g)) for k, g in NOUNS])


def position(low: Column, n: Column) -> Column:
    """The place from zero, among n in order, that a request asks for by number or by side; null if by neither."""
    k, vertical = ordinal(low), low.rlike("top|bottom|upper|lower")
    return (
        F.when(k.isNotNull(), F.least(k, n) - 1).when(low.rlike(LAST), n - 1).when(low.rlike(FIRST), 0).when(low.rlike(MIDDLE), F.floor(n / 2))
        .when(vertical & low.rlike("top|upper"), 0).when(vertical & low.rlike("bottom|lower"), n - 1)
    )


def label_score(low: Column, label: Column, role: Column) -> Column:
    """How well a request's words name a region: words of more than two bytes in its label and role, and three more if
    the label and the request hold one another."""
    label, role = F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(role, F.lit("")))
    hay = F.concat_ws(" ", label, role)
    words = F.filter(F.split(low, r"\s+"), lambda w: (F.octet_length(w) > 2) & hay.contains(w))
    held = (label != "") & (low.contains(label) | label.contains(F.btrim(low)))
    return F.when(F.btrim(hay) != "", F.size(words) + F.when(held, 3).otherwise(0)).otherwise(0)


def located(requests: DataFrame, regions: DataFrame) -> DataFrame:
    """(frame_id, idx) for each request (frame_id, request) on a frame's regions (frame_id, idx, x, y, kind, label, role):
    of the granularity it names, or of all if it has none of it, the region at the position asked for, else the first
    with the best label; idx is null if none fits."""
    low = F.lower("request")
    r = requests.select("frame_id", low.alias("low")).withColumn("want", wanted_granularity(F.col("low"))).join(regions, "frame_id")
    frame = Window.partitionBy("frame_id")
    fits = F.coalesce(F.col("kind") == F.col("want"), F.lit(True))
    r = r.withColumn("fits", fits).withColumn("any", F.max("fits").over(frame)).where("fits or not any")
    vertical = F.col("low").rlike("top|bottom|upper|lower")
    order = frame.orderBy(F.when(vertical, F.col("y")).otherwise(F.col("x")), F.when(vertical, F.col("x")).otherwise(F.col("y")), "idx")
    r = r.withColumn("n", F.count(F.lit(1)).over(frame)).withColumn("place", F.row_number().over(order) - 1)
    r = r.withColumn("at", position(F.col("low"), F.col("n"))).withColumn("score", label_score(F.col("low"), F.col("label"), F.col("role")))
    picked = F.max(F.when(F.col("place") == F.col("at"), F.col("idx")))
    named = F.max(F.when(F.col("score") > 0, F.struct("score", (-F.col("idx")).alias("i"))))
    best = r.groupBy("frame_id").agg(F.max("at").alias("at"), picked.alias("p"), named.alias("m"))
    best = best.select("frame_id", F.when(F.col("at").isNotNull(), F.col("p")).otherwise(-F.col("m.i")).alias("idx"))
    return requests.select("frame_id").join(best, "frame_id", "left")


# -- quads ------------------------------------------------------------------------------------------------------------


def ordered_quad(corners: Column) -> Column:
    """Four corners (x, y) clockwise from the one nearest the top left, with y down."""
    mean = lambda c: F.aggregate(corners, F.lit(0.0), lambda a, p: a + p[c]) / 4
    round_ = F.transform(F.array_sort(F.transform(corners, lambda p, i: F.struct(F.atan2(p["y"] - mean("y"), p["x"] - mean("x")).alias("a"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    sums = F.transform(round_, lambda p: p["x"] + p["y"])
    start = F.array_position(sums, F.array_min(sums)).cast("int")
    return F.concat(F.slice(round_, start, 4), F.slice(round_, 1, start - 1))


def valid_quad(q: Column) -> Column:
    """Whether corners are distinct and turn clockwise at each of them."""
    p = lambda i: q[i % 4]
    apart = F.lit(True)
    for i in range(4):
        for j in range(i + 1, 4):
            apart = apart & ~((F.abs(p(i)["x"] - p(j)["x"]) < 1e-6) & (F.abs(p(i)["y"] - p(j)["y"]) < 1e-6))
    turns = F.lit(True)
    for i in range(4):
        a, b, c = p(i), p(i + 1), p(i + 2)
        turns = turns & ((b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]) > 0)
    return apart & turns


def clipped_corners(q: Column, w: int, h: int, margin: float) -> Column:
    """Names of the corners within a margin of a frame's edge."""
    names = F.array(*map(F.lit, ("top_left", "top_right", "bottom_right", "bottom_left")))
    near = lambda p: (p["x"] <= margin) | (p["x"] >= w - 1 - margin) | (p["y"] <= margin) | (p["y"] >= h - 1 - margin)
    return F.filter(F.zip_with(q, names, lambda p, n: F.when(near(p), n)), lambda x: x.isNotNull())


def medoids(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, id): of each group's points (by, id, x, y) the one with the least sum of distances to all, the first of equal
    ones. Groups are shifts of one burst or boxes of one frame, so their pairs are few."""
    other = points.select(*by, F.col("x").alias("ox"), F.col("y").alias("oy"))
    cost = F.round(F.sum(F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))), 6)
    costs = points.join(other, by).groupBy(*by, "id").agg(cost.alias("cost"))
    return costs.groupBy(*by).agg(F.min(F.struct("cost", "id")).alias("m")).select(*by, F.col("m.id").alias("id"))

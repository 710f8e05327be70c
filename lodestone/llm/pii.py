"""Personal data: base patterns, high-recall candidates, boosted trees, calibrated thresholds.

All steps are Spark expressions.  A pattern's matches are marked in a copy of the text, which is
split at the marks; running lengths give the places, in code points.

Base spans (email, ip, card, phone) are exact patterns with checks and always stay.  Generators
propose further, overlapping spans: written-out addresses, numbers without a plus sign, cards with dots, dotted
and colon-separated addresses, long keys.  For each kind, boosted trees score a candidate by
format (digits, groups, separators, last length, a check of its own) and context (the words before).

Labels.  They learn from all candidates of all documents, aggregated to counts by feature vector.  A candidate that
meets a valid base span of its kind is positive, and so is one that is written out or named by its
context: an address with [at] or (at) and a dotted name, a number behind a word such as call, a card number with a
right sum behind a word such as visa.  Negative are those that fail the check of their kind, that meet a
base span of another kind, or that the context names otherwise (order, version, page).  The rest is unlabelled, has no
part in learning, and is scored like all others.  Keys have no base pattern: they are positive if a
word such as token or password and an equals sign or colon stand before them, negative else, and scored by format alone.

Thresholds.  Trees grow on three quarters of the texts, by hash; the threshold of a kind is the least whose precision on the
labels of the rest is ``precision`` or more.  A candidate is added if its probability reaches it and it meets
no base span; of added ones that overlap, going from left to right, the better one stays.

The text is scanned once; what is found goes to a table in the shared folder, from which
both the counts and the result are read.  Work on a text grows with its length and its spans, not with their square.

Defined results: null and empty texts have no spans; null doc_ids and repeated rows are treated
like any others; a corpus without candidates adds no spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import let, packed, written

KINDS = ("email", "ip", "card", "phone", "secret")  # the order of kinds among spans
BASE = KINDS[:4]
#: Feature -> how many values it has.  The driver gets as many counts as there are vectors at most, some 53,000 a kind.
FEATURES = {"digits": 21, "groups": 6, "sep": 6, "last": 5, "ctx": 7, "good": 2}
HELD = 4  # one part in so many sets the thresholds
RUN = 256  # elements of an array that a loop goes through at a time
CUT = 4096  # characters of a piece of a text that is rewritten
_OPEN, _CLOSE = "\x01", "\x02"

# Base patterns.  Possessive loops where nothing that follows could use what they give back, and
# \G or a look behind where a match could else begin within a run that has failed: linear time.
_LOCAL = r"[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"  # runs of fewer digits are dropped in any case
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Generators.
_SIGN = r"(?:@|\x20?[(\[]\x20?at\x20?[)\]]\x20?)"
_AT = rf"(?:{_SIGN}|\x20at\x20)"
_DOT = r"(?:\.|\x20?[(\[]\x20?dot\x20?[)\]]\x20?|\x20dot\x20)"
_NAME = rf"[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++"
_KEY = r"[A-Za-z0-9_/+-]"
_KEYS = rf"{_KEY}++(?:\.{_KEY}++)*+"
#: By kind; what follows an underscore tells generators of one kind apart.
GENERATORS = {
    # a bare "at" is a common word, so it needs a dotted name that is not itself the local part of an address
    "email": rf"(?i)(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:{_SIGN}[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)*+|\x20at\x20{_NAME}(?!{_LOCAL}*+(?:{_SIGN}|\x20at\x20{_NAME})))",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,5}(?:\.[0-9]{1,5}){2,5}+|(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20.-]?[0-9]){11,24}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.,:/-])(?:(?:\+[\x20.-]?|00)?(?:[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,}+\)?(?:[\x20./-]{1,2}[0-9]{2,}+){1,4}+|\+?[0-9]{7,}+)(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_+-]*+[0-9])[A-Za-z0-9_+-]{20,}+(?![A-Za-z0-9_/+-])",
    # keys that hold a slash, a dot or an equals sign; the latter only after twenty others, as a name may stand before one
    "secret_mixed": rf"(?<!{_KEY})(?<!{_KEY}\.)(?=[A-Za-z0-9_+-]*+(?:[/=]|\.{_KEY}))(?=(?:\.?{_KEY}){{20}})(?=(?:\.?[A-Za-z_/+-])*+\.?[0-9]){_KEYS}(?:=++{_KEYS})*+=*+",
}
#: Cheap tests that every text with a match passes, begun by a rare character where possible.
_IP_NEEDS = (r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",)
_CARD_NEEDS = (r"[0-9](?:[\x20-]?[0-9]){11}",)
_NEEDS = {
    "email": (rf"(?i)@|[(\[]\x20?at\x20?[)\]]|\x20at\x20[a-z0-9-]++{_DOT}[a-z0-9-]",),
    "ip": (r"[0-9]\.[0-9]+\.[0-9]|:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:",),
    "card": (r"[0-9](?:[\x20.-]?[0-9]){11}",),
    "phone": (r"[0-9]\)?(?:[\x20./-]{1,2}[0-9]{2}|[0-9]{6})",),
    "secret": (r"[0-9]", r"[A-Za-z0-9_+-]{20}"),
    "secret_mixed": (r"[0-9]", r"(?<![A-Za-z0-9_/+.-])[A-Za-z0-9_/+.-]{20}"),
}
#: Words before a candidate that tell what it is; the class is the position, 0 for none.
CONTEXT = (
    r"(?:tel|phone|call|mobile|fax|telefon|teléfono|téléphone)",
    r"(?:card|visa|amex|mastercard|tarjeta|carte|karte)",
    r"(?:ip|host|server|address|addr)",
    r"(?:mail|contact|correo|courriel)",
    r"(?:token|key|secret|password|passwd|pwd|bearer)",
    r"(?:order|invoice|isbn|version|ref|id|no|nr|page|date)",
)


def _clean(text: Column) -> Column:
    """The text without null and with the two marks replaced, each by one other control character."""
    return F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, "\x03\x03")


SPAN = "struct<start:int,kind:int,end:int>"
MATCH = "struct<start:int,end:int,body:string,before:string>"


def empty(kind: str) -> Column:
    return F.expr(f"CAST(array() AS array<{kind}>)")


def _gathered(values: Column, zero: Column, op, kind: str) -> Column:
    """running() by a loop whose state is copied at each step: for short arrays."""
    start = F.struct(zero.alias("now"), empty(kind).alias("out"))
    return F.aggregate(values, start, lambda acc, x: F.struct(op(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")), lambda acc: acc["out"])


def running(values: Column, zero: Column, op, kind: str = "int") -> Column:
    """For each place of an array, op over all that stand before it.

    A long array is cut into runs of RUN.  Each is reduced to one value, and begins with what the runs before it
    give, so no long state is carried along.
    """

    def by_runs(runs: Column) -> Column:
        before = _gathered(F.transform(runs, lambda r: F.aggregate(r, zero, op)), zero, op, kind)
        return let(before, lambda first: F.flatten(F.transform(runs, lambda r, j: _gathered(r, F.get(first, j), op, kind))))

    def cut(all_: Column) -> Column:
        last = F.call_function("div", F.size(all_) - 1, F.lit(RUN)).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(all_, j * RUN + 1, RUN)), by_runs)

    return let(values, cut)


def plus(a: Column, b: Column) -> Column:
    return a + b


def later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def find(text: Column, pattern: str, needs: tuple[str, ...] = ()) -> Column:
    """Leftmost matches that do not overlap: array of (start, end, body, before).

    Places are code points; ``before`` holds up to 24 characters in front.
    """
    # what stands between the marks: text, match, text, match, ..., text
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}")), f"[{_OPEN}{_CLOSE}]", -1)

    def placed(ps: Column) -> Column:
        def each(at: Column) -> Column:
            def one(i: Column) -> Column:
                start, body = F.get(at, i), F.get(ps, i)
                return F.struct(start.alias("start"), (start + F.length(body)).alias("end"), body.alias("body"), F.right(F.get(ps, i - 1), F.lit(24)).alias("before"))

            return F.transform(F.sequence(F.lit(1), F.size(ps) - 2, F.lit(2)), one)

        return F.when(F.size(ps) > 2, let(running(F.transform(ps, F.length), F.lit(0), plus), each)).otherwise(empty(MATCH))

    test = F.lit(True)
    for p in needs or (pattern,):
        test = test & text.rlike(p)
    return F.when(test, let(parts, placed)).otherwise(empty(MATCH))


def luhn(digits: Column) -> Column:
    """Whether the digits' check sum is right: every second one from the end counts double."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), one)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _part_ok(part: Column) -> Column:
    """At most 255, however many zeros or digits there are."""
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(short) <= 3) & (F.left(short, F.lit(3)).try_cast("int") <= 255)


def base_spans(text: Column) -> dict[str, Column]:
    """Valid matches of each base pattern in a cleaned text."""
    n = lambda m: F.length(_digits(m["body"]))
    return {
        "email": find(text, _EMAIL, ("@",)),
        "ip": F.filter(find(text, _IP, _IP_NEEDS), lambda m: F.forall(F.split(m["body"], r"\."), _part_ok)),
        "card": F.filter(find(text, _CARD, _CARD_NEEDS), lambda m: n(m).between(12, 19) & luhn(_digits(m["body"]))),
        "phone": F.filter(find(text, _PHONE, (r"\+[0-9]",)), lambda m: n(m).between(9, 15)),
    }


def _context(before: Column) -> Column:
    out = F.lit(0)
    for k, pattern in reversed(list(enumerate(CONTEXT, 1))):
        out = F.when(before.rlike(rf"(?i)\b{pattern}\b[^A-Za-z0-9]{{0,6}}$"), F.lit(k)).otherwise(out)
    return out


#: Of a candidate: its place among all, kind, bounds, features, what its form and context say (1, 0 or nothing).
CANDIDATE = "struct<i:int,kind:int,start:int,end:int," + ",".join(f"{f}:int" for f in FEATURES) + ",named:int>"
JUDGED = CANDIDATE[:-1] + ",label:int,meets:boolean>"


def _features(kind: str, m: Column) -> Column:
    """A candidate with its features and what its form and context say."""
    raw = m["body"]
    body = raw
    if kind == "email":
        body = F.regexp_replace(F.regexp_replace(F.lower(raw), _AT, "@"), _DOT, ".")
    if kind == "phone":  # a plus sign decides base spans, so it and the country code are left out
        body = F.regexp_replace(raw, r"^\+[0-9]{1,3}[\x20.-]?", "")
    groups = F.filter(F.split(body, "[^A-Za-z0-9]+", -1), lambda g: g != "")
    n = F.length(_digits(raw))
    context = _context(m["before"])
    sep = (
        F.when(body.rlike("[(]"), F.lit(5)).when(body.rlike("@"), F.lit(4)).when(body.rlike("[.:]"), F.lit(3)).when(body.rlike("-"), F.lit(2)).when(body.rlike(" "), F.lit(1)).otherwise(F.lit(0))
    )
    yes, no, open_ = F.lit(1), F.lit(0), F.lit(None).cast("int")
    other = context == 6
    if kind == "email":
        bare, bracket = raw.rlike(r"(?i)\x20at\x20(?![)\]])"), raw.rlike(r"(?i)[(\[]\x20?at")
        sep = F.when(bracket, F.lit(5)).when(bare, F.lit(1)).otherwise(F.lit(4))
        good = body.rlike(r"^[^@]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}$")
        named = F.when(~good | other, no).when(bracket | (context == 4) | (bare & raw.rlike(r"(?i)\x20dot\x20")), yes).when(bare, no).otherwise(open_)
    elif kind == "ip":
        dotted = raw.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & F.forall(F.split(raw, r"\."), _part_ok)
        good = dotted | raw.rlike("(?i)^(?=.*[a-f]).*:")
        named = F.when(~good | other, no).when((context == 3) | raw.rlike(":"), yes).otherwise(open_)
    elif kind == "card":
        good = n.between(12, 19) & luhn(_digits(raw))
        named = F.when(~good | other, no).when(context == 2, yes).otherwise(open_)
    elif kind == "phone":
        date = raw.rlike(r"^(?:[0-9]{4}[./-][0-9]{2}[./-][0-9]{2}|[0-9]{2}[./-][0-9]{2}[./-](?:[0-9]{2}){1,2})$")
        good = n.between(7, 15) & ~date
        named = F.when(~good | context.isin(2, 6), no).when(context == 1, yes).when(~raw.startswith("+") & (F.size(groups) == 1), no).otherwise(open_)
    else:
        good = F.length(F.regexp_replace(raw, "[^A-Za-z]", "")).between(4, 1 << 30) & (n >= 4)
        named = F.when((context == 5) & m["before"].rlike("[=:][^A-Za-z0-9]{0,3}$"), yes).otherwise(no)
        context = F.lit(0)
    return F.struct(
        F.lit(0).alias("i"),
        F.lit(KINDS.index(kind)).alias("kind"),
        m["start"].alias("start"),
        m["end"].alias("end"),
        F.least(n if kind != "phone" else F.length(_digits(body)), F.lit(20)).alias("digits"),
        F.least(F.size(groups), F.lit(5)).alias("groups"),
        sep.alias("sep"),
        F.least(F.length(F.coalesce(F.try_element_at(groups, F.lit(-1)), F.lit(""))), F.lit(4)).alias("last"),
        context.alias("ctx"),
        good.cast("int").alias("good"),
        named.alias("named"),
    )


def _judged(candidates: Column, base: Column) -> Column:
    """Candidates with their label and whether they meet a base span, in their order.

    Base spans go by their start and candidates by their end, in one order: what began before a
    candidate's end meets it if the furthest end of these lies behind the candidate's start.
    """
    nothing = F.lit(None).cast(CANDIDATE)
    events = F.array_sort(
        F.concat(
            F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("open"), b["kind"].alias("kind"), b["end"].alias("far"), nothing.alias("c"))),
            F.transform(candidates, lambda c, i: F.struct(c["end"].alias("at"), F.lit(0).alias("open"), F.lit(0).alias("kind"), F.lit(0).alias("far"), c.withField("i", i).alias("c"))),
        )
    )
    names = ["i", "kind", "start", "end", *FEATURES, "named"]

    def swept(es: Column) -> Column:
        """The furthest end of each kind before every event, then the candidates among the events."""
        none = F.struct(*[F.lit(-1).alias(k) for k in BASE])
        ends_of = F.transform(es, lambda e: F.struct(*[F.when((e["open"] == 1) & (e["kind"] == k), e["far"]).otherwise(F.lit(-1)).alias(name) for k, name in enumerate(BASE)]))
        far = running(ends_of, none, lambda a, b: F.struct(*[F.greatest(a[k], b[k]).alias(k) for k in BASE]), "struct<" + ",".join(f"{k}:int" for k in BASE) + ">")

        def each(furthest: Column) -> Column:
            def one(e: Column, i: Column) -> Column:
                c, ends = e["c"], [F.get(furthest, i)[k] for k in BASE]
                own = F.lit(False)
                for k, end in enumerate(ends):
                    own = F.when(c["kind"] == k, end > c["start"]).otherwise(own)
                meets = F.greatest(*ends) > c["start"]
                label = F.when(own, 1).when(meets, 0).otherwise(c["named"])
                out = F.struct(*[c[n].alias(n) for n in names], label.alias("label"), meets.alias("meets"))
                return F.when(e["open"] == 0, out)

            return F.filter(F.transform(es, one), lambda c: c.isNotNull())

        return let(far, each)

    return F.when(F.size(candidates) > 0, F.array_sort(let(events, swept)).cast(f"array<{JUDGED}>")).otherwise(empty(JUDGED))


def scan(docs: DataFrame, text: str = "text", keep: bool = True) -> DataFrame:
    """row (all columns of docs, without the text unless keep), base (array of start, kind, end) and candidates; one
    pass over the text."""
    # the cleaned text and the base spans are columns of their own, so they are computed once
    found = docs.select(packed(docs, *([] if keep else [text])), _clean(F.col(text)).alias("clean"), F.pmod(F.xxhash64(text), F.lit(HELD)).alias("part"))
    found = found.select("*", *[c.alias(k) for k, c in base_spans(F.col("clean")).items()])

    def proposed(name: str) -> Column:
        return F.transform(find(F.col("clean"), GENERATORS[name], _NEEDS[name]), lambda m: _features(name.split("_")[0], m))

    def placed(kind: str) -> Column:
        which = F.lit(KINDS.index(kind)).alias("kind")
        return F.transform(F.col(kind), lambda m: F.struct(m["start"].alias("start"), which, m["end"].alias("end")))

    found = found.select("row", "part", F.array_sort(F.concat(*map(placed, BASE))).alias("base"), F.concat(*map(proposed, GENERATORS)).alias("proposed"))
    return found.select("row", "part", "base", _judged(F.col("proposed"), F.col("base")).alias("candidates"))


def train(scanned: DataFrame, precision: float = 0.9) -> dict[str, boosting.Boosted]:
    """Trees and threshold for each kind from all labelled candidates, as counts by feature vector."""
    key = F.lit(0).cast("long")
    for f, n in {"kind": len(KINDS), **FEATURES}.items():
        key = key * n + F.col(f"c.{f}")
    held = F.col("part") == 0
    sums = [F.count_if((F.col("c.label") == y) & (held if h else ~held)) for h in (False, True) for y in (1, 0)]
    labelled = scanned.select("part", F.explode("candidates").alias("c")).where("c.label IS NOT NULL")
    counts = labelled.groupBy(key.alias("key")).agg(*[c.alias(f"n{i}") for i, c in enumerate(sums)])
    seen: dict[str, list[boosting.Row]] = {k: [] for k in KINDS}
    kept: dict[str, list[boosting.Row]] = {k: [] for k in KINDS}
    # bounded by the ranges of the features, whatever the corpus
    for k, *n in counts.collect():
        vector = []
        for size in reversed(FEATURES.values()):
            vector.append(k % size)
            k //= size
        x = tuple(reversed(vector))
        seen[KINDS[k]].append((x, float(n[0]), float(n[1])))
        kept[KINDS[k]].append((x, float(n[2]), float(n[3])))
    return {k: boosting.fit(seen[k], precision, kept[k]) for k in KINDS}


def _at_least(least: float):
    return lambda v: F.when(v >= least, v).otherwise(-1.0)


def select(scanned: DataFrame, models: dict[str, boosting.Boosted]) -> DataFrame:
    """scanned with ``spans``: base spans and selected candidates as (start, kind, end), in order."""
    scored = "struct<start:int,end:int,p:double,kind:int>"

    def with_p(c: Column) -> Column:
        features = [c[f] for f in FEATURES]
        p = F.lit(-1.0)
        for k, name in enumerate(KINDS):
            if models[name].threshold <= 1:
                # a lambda of two parameters would be given places for the second
                least, q = models[name].threshold - 1e-9, models[name].column(features)
                p = F.when(c["kind"] == k, let(q, _at_least(least))).otherwise(p)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), p.alias("p"), c["kind"].alias("kind"))

    likely = F.filter(F.transform(F.filter("candidates", lambda c: ~c["meets"]), with_p), lambda c: c["p"] > 0)

    def span(c: Column) -> Column:
        return F.array(F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))

    def of_chain(chain: Column) -> Column:
        """From left to right: the last one stays if the next begins behind it; else the likelier does, the longer of two alike, or the first."""
        def step(acc: Column, c: Column) -> Column:
            last = acc["last"]
            free = c["start"] >= last["end"]
            better = (c["p"] > last["p"]) | ((c["p"] == last["p"]) & (c["end"] - c["start"] > last["end"] - last["start"]))
            return F.struct(F.when(free | better, c).otherwise(last).alias("last"), F.when(free & (last["p"] > 0), F.concat(acc["out"], span(last))).otherwise(acc["out"]).alias("out"))

        nothing = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(-1.0).alias("p"), F.lit(0).alias("kind")).cast(scored)
        return F.aggregate(chain, F.struct(nothing.alias("last"), empty(SPAN).alias("out")), step, lambda acc: F.concat(acc["out"], span(acc["last"])))

    def chosen(cs: Column) -> Column:
        """Candidates are cut into chains, each of which begins behind all ends before it."""
        def chains(furthest: Column) -> Column:
            begins = F.filter(F.sequence(F.lit(0), F.size(cs) - 1), lambda i: F.get(cs, i)["start"] >= F.get(furthest, i))
            return let(begins, lambda bs: F.flatten(F.transform(bs, lambda b, j: of_chain(F.slice(cs, b + 1, F.coalesce(F.get(bs, j + 1), F.size(cs)) - b)))))

        return let(running(F.transform(cs, lambda c: c["end"]), F.lit(-1), later), chains)

    out = scanned.select("row", "base", likely.alias("likely"))
    spans = F.array_sort(F.concat("base", let(F.array_sort("likely"), chosen)))
    return out.select("row", "base", F.when(F.size("likely") > 0, spans).otherwise(F.col("base")).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def detect(docs: DataFrame, text: str = "text", precision: float = 0.9) -> DataFrame:
    """row (the columns of docs without the text), base and spans."""
    scanned = written(scan(docs, text, keep=False), "pii")
    return select(scanned, train(scanned, precision))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping ones, replaced by its first kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        """Characters a to b of the text, as an array of the parts of its blocks."""
        first, last = F.call_function("div", a, F.lit(CUT)).cast("int"), F.call_function("div", b - 1, F.lit(CUT)).cast("int")
        one = F.array(F.substring(F.get(blocks, first), a % CUT + 1, b - a))
        ends = F.array(F.substring(F.get(blocks, first), a % CUT + 1, F.lit(CUT))), F.array(F.substring(F.get(blocks, last), F.lit(1), b - last * CUT))
        more = F.concat(ends[0], F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ends[1])
        return F.when(b <= a, empty("string")).when(first == last, one).otherwise(more)

    def done(blocks: Column) -> Column:
        def whole(at: Column) -> Column:
            """at: the furthest end before each span."""
            def one(s: Column, i: Column) -> Column:
                out = F.concat(cut(blocks, F.get(at, i), s["start"]), F.array(F.element_at(names, s["kind"] + 1)))
                return F.when(s["start"] >= F.get(at, i), out).otherwise(empty("string"))

            rest = cut(blocks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text))
            return F.array_join(F.concat(F.flatten(F.transform(spans, one)), rest), "")

        return let(running(F.transform(spans, lambda s: s["end"]), F.lit(0), later), whole)

    return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), done)).otherwise(text)


def redact(docs: DataFrame, text: str = "text", precision: float = 0.9) -> DataFrame:
    """docs, same columns and rows, with personal data in the text replaced; null texts stay null."""
    scanned = written(scan(docs, text), "pii")
    found = select(scanned, train(scanned, precision))
    shown = redacted(F.col("row")[text], F.col("spans"))
    return found.select(*[shown.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, a hash of these, and all spans."""
    found = detect(docs.select("doc_id", "text"))

    def count(kind: str) -> Column:
        which = BASE.index(kind)
        return F.size(F.filter("base", lambda s: s["kind"] == which)).cast("long").alias(f"n_{kind}")

    return found.select("row.doc_id", *map(count, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

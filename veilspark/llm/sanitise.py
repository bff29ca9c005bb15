"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Base spans (email, ip, card, phone) are found by patterns.  The protected entities are their values, and each kind as a whole.
Terms of the same document may give them away: how strongly a term reveals an entity is the pointwise mutual information of the
two over the corpus's documents, as a share of what the entity itself carries (1: the term occurs with it alone).  Terms above the
disclosure thresholds are generalised or removed wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialise

#: The order of kinds that start at the same place.
KINDS = ["email", "ip", "card", "phone", "term"]
#: Patterns as specified, with possessive repeats where what follows can't take back a character, and the email's and ip's
#: start tied to the start of a run: both match the same text in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has no span of the kind.
_GUARDS = {"email": "[@]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Most terms that are broadcast; more of them are joined by shuffle.
SENT_TERMS = 200_000
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Arrays are built up in blocks of so many, so that long texts with many matches take little more than one pass.
_BLOCK = 256


def _scan(items: Column, element: str, step) -> Column:
    """array<element> from items in order, with a place in the text carried along: step(place, item) gives the next place, and the element or null."""
    empty = F.array().cast(f"array<{element}>")
    state = lambda at, out: F.struct(at.cast("int").alias("at"), out.alias("out"))

    def one(acc: Column, x: Column) -> Column:
        at, new = step(acc["at"], x)
        return state(at, F.when(new.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], new)))

    def block(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, state(acc["at"], empty), one)
        return _let(done, lambda d: state(d["at"], F.concat(acc["out"], d["out"])))

    blocks = _let(items, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int"))), lambda b: F.slice(x, b * _BLOCK + 1, _BLOCK)))
    return F.aggregate(blocks, state(F.lit(0), empty), block, lambda acc: acc["out"])


def _with_gaps(text: Column, pattern: str) -> Column:
    """Matches with what stands before each: their lengths give their places."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    return F.filter(pairs, lambda x: x["value"].isNotNull())


def find_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, in code points: what lies between matches gives their places."""
    span = "struct<start:int,end:int,value:string>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        first = at + x["gap"]
        last = first + F.length(x["value"])
        return last, F.struct(first.alias("start"), last.alias("end"), x["value"].alias("value")).cast(span)

    return _scan(_with_gaps(text, pattern), span, step)


def _luhn(digits: Column) -> Column:
    def digit(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + digit(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    if kind == "card":
        return _let(digits, lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _spans_of_kind(text: Column, kind: str) -> Column:
    good = F.filter(find_spans(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def _has_kind(k: int) -> Column:
    return F.exists("spans", lambda s: s["kind"] == k)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of base spans of all kinds: kind is its place in KINDS.  Ordered by start, then kind."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for kind in KINDS[:4]:
        parts.append(F.when(F.rlike(text, F.lit(_GUARDS[kind])), _spans_of_kind(text, kind)).otherwise(none))
    return F.array_sort(F.concat(*parts))


#: Stands for what a base pattern matches where words are counted; no text has this noncharacter.
_CUT = "\ufdd0"


def distinct_terms(text: Column, spans: Column) -> Column:
    """The distinct words of a whole text, lower-cased; in texts with spans but those that touch a match of a base pattern."""
    cut = text
    for kind in KINDS[:4]:
        cut = F.regexp_replace(cut, F.lit(PATTERNS[kind]), F.lit(_CUT))
    words = F.array_distinct(F.split(F.lower(F.when(F.size(spans) == 0, text).otherwise(cut)), SPACE + "+"))
    return F.filter(words, lambda w: (w != "") & ~F.contains(w, F.lit(_CUT)))


def term_places(text: Column, spans: Column, strong: Column) -> Column:
    """array<struct<start, kind, end, action>> of every occurrence of the words in strong (word to action) that overlaps no span."""
    place = "struct<start:int,kind:int,end:int,action:string>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        first = at + x["gap"]
        last = first + F.length(x["value"])
        action = F.try_element_at(strong, F.lower(x["value"]))
        # Only words with an action are held against the spans.
        free = ~F.exists(spans, lambda s: (s["start"] < last) & (first < s["end"]))
        hit = F.struct(first.alias("start"), F.lit(4).alias("kind"), last.alias("end"), action.alias("action")).cast(place)
        return last, F.when(action.isNotNull() & free, hit)

    return _scan(_with_gaps(text, WORD), place, step)


def disclosure(found: DataFrame, least_docs: int, least: float = 0.0) -> DataFrame:
    """kind, value, term, docs_with, docs_of, docs_entity, disclosure (of ``least`` or more) of terms and the entities that they reveal.

    ``found`` has a row for each document: _row, its text (_t) and spans.  Documents are the unit of all counts: those with the term,
    with the entity, with both, wherever they stand in the text.  An entity is a span's value, lower-cased, or (value null) any span
    of its kind.  A term and an entity must meet in least_docs different texts or more, so copies of one text reveal nothing.
    """
    has = [F.count_if(_has_kind(k)) for k in range(4)]
    n, *_ = found.agg(F.count("*"), *has).first()
    words = found.select(F.explode(distinct_terms(F.col("_t"), F.col("spans"))).alias("term"), *(_has_kind(k).alias(f"_has{k}") for k in range(4)))
    counts = words.groupBy("term").agg(F.count("*").alias("docs_of"), *(F.count_if(f"_has{k}").alias(f"_with{k}") for k in range(4)))
    most = F.greatest(*(F.col(f"_with{k}") for k in range(4)))
    # A term is no more often with a value than with its kind: what can't reach ``least`` with the rarest entity goes.
    bound = (least_docs / max(1, n)) ** (1 - least)
    terms = materialise(counts.where((most >= least_docs) & (most >= bound * (1 - 1e-9) * F.col("docs_of"))).select("term", "docs_of"), "private-counts")
    terms = F.broadcast(terms) if terms.count() <= SENT_TERMS else terms
    private = found.where(F.size("spans") > 0)
    value = lambda s: F.lower(F.substring(F.col("_t"), s["start"] + 1, s["end"] - s["start"]))
    both = lambda s: F.array(F.struct(s["kind"].alias("kind"), value(s).alias("value")), F.struct(s["kind"].alias("kind"), F.lit(None).cast("string").alias("value")))
    own = private.select("_row", F.explode(F.array_distinct(F.flatten(F.transform("spans", both)))).alias("e")).select("_row", "e.*")
    entities = materialise(own.groupBy("kind", "value").agg(F.count("*").alias("docs_entity")).where(F.col("docs_entity") >= least_docs), "private-entities")
    own = own.join(entities.withColumnsRenamed({"kind": "_k", "value": "_v"}), (F.col("kind") == F.col("_k")) & F.col("value").eqNullSafe(F.col("_v"))).select("_row", "kind", "value", "docs_entity")
    met = private.select("_row", F.xxhash64("_t").alias("_h"), F.explode(distinct_terms(F.col("_t"), F.col("spans"))).alias("term")).join(terms, "term")
    pairs = met.join(own, "_row").groupBy("kind", "value", "term", "docs_of", "docs_entity", "_h").agg(F.count("*").alias("m"))
    pairs = pairs.groupBy("kind", "value", "term", "docs_of", "docs_entity").agg(F.sum("m").alias("docs_with"), F.count("*").alias("texts")).where(F.col("texts") >= least_docs)
    p = F.col("docs_entity") / max(1, n)
    pmi = F.log2(F.col("docs_with") / F.col("docs_of") / p)
    return pairs.select("kind", "value", "term", "docs_with", "docs_of", "docs_entity", F.when(p < 1, pmi / -F.log2(p)).otherwise(0.0).alias("disclosure")).where(F.col("disclosure") >= least)


def find_private(docs: DataFrame, generalise: float = 0.6, remove: float = 0.9, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array<struct<start, kind, end, action>> by start and kind, of all whole texts, and sanitised: the text after the actions.

    Actions: mask (base spans), generalise or remove (terms, in all texts).  A null text is empty.  Rows that repeat each get a row;
    they count as several documents in the corpus statistics, and as one text.  Very long texts are read whole.  Other columns are
    not read, whatever their names.  An empty table gives an empty result.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    found = materialise(texts.select("*", base_spans(F.col("_t")).alias("spans")), "private-spans")
    action = F.when(F.max("disclosure") >= remove, "remove").otherwise("generalise")
    strong = materialise(disclosure(found, least_docs, generalise).groupBy("term").agg(action.alias("action")), "private-terms")
    strong = F.broadcast(strong) if strong.count() <= SENT_TERMS else strong
    own = found.select("_row", F.explode(distinct_terms(F.col("_t"), F.col("spans"))).alias("term")).join(strong, "term")
    # A document's own strong terms: at most its distinct words.
    own = own.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("strong"))
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit("mask").alias("action")))
    more = term_places(F.col("_t"), F.col("spans"), F.col("strong"))
    out = found.join(own, "_row", "left").select("doc_id", "_t", F.when(F.col("strong").isNull(), base).otherwise(F.array_sort(F.concat(base, more))).alias("spans"))
    return out.select("doc_id", "spans", sanitise_text(F.col("_t"), F.col("spans")).alias("sanitised"))


def sanitise_text(text: Column, spans: Column) -> Column:
    """The text with base spans as [KIND], generalised terms as [TERM] and removed ones left out; of overlapping spans, the first."""
    cut = "struct<start:int,end:int,label:string>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        label = F.when(s["action"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(F.get(F.array(*(F.lit(k) for k in KINDS)), s["kind"])), F.lit("]")))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.struct(s["start"].alias("start"), s["end"].alias("end"), label.alias("label")).cast(cut))

    def pieces(cuts: Column) -> Column:
        last = lambda i: F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0))
        before = F.transform(cuts, lambda c, i: F.concat(F.substring(text, last(i) + 1, c["start"] - last(i)), c["label"]))
        return F.concat(F.array_join(before, ""), F.substring(text, last(F.size(cuts)) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(_scan(spans, cut, step), pieces))


def span_text(spans: Column, last_kind: int) -> Column:
    """kind:start:end of the spans up to a kind, joined by commas."""
    named = F.transform(F.filter(spans, lambda s: s["kind"] <= last_kind), lambda s: F.concat_ws(":", F.get(F.array(*(F.lit(k) for k in KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(named, ",")

"""Personal data: fixed patterns, and terms that the corpus shows to give a protected value away.

Following information-theoretic sanitisation, a value found by the patterns is a protected entity e, and so is
each class that it belongs to: an address's domain and local part, a network, the head of a number. A term
t of the same document discloses the share PMI(t; e) / IC(e) of its information, with probabilities estimated
from the documents: IC(e) = -log p(e), PMI = log p(e | t) / p(e), where p(e | t) is smoothed by PRIOR documents
in which e is as frequent as in all. Terms at or over the threshold are generalised wherever they stand in the
documents that hold the entity.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rigtables.llm.common import kept, looked_up, small_batches, table, written

KINDS = ("email", "ip", "card", "phone")
#: Characters of an address before the @, and what follows them.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match cannot begin inside a run of digits, as it would have begun before; so none is tried there.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[^0-9]+")
TERM = re.compile(r"[^\W_]+")
#: Share of an entity's information that a term may disclose; terms that a task holds to count them; the most terms known to every task.
DISCLOSED, HELD, COMMON, SEED = 0.5, 250_000, 1 << 18, 42
#: Documents by which p(e | t) is smoothed.
PRIOR = 2.0


def _byte(digits: str) -> bool:
    least = digits.lstrip("0")
    return len(least) <= 3 and int(least or 0) <= 255


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ is taken with the longest run before it and domain after it, in time that grows with the text."""
    last = 0
    at = text.find("@")
    while at >= 0:
        before = text[last:at]
        start = last + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        last = m.end() if m else at + 1
        at = text.find("@", last)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start; a null text has none."""
    if not text:
        return []
    found = [("email", *s) for s in emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.sub("", m[0])) <= 15]
    return found


def entity(kind: str, value: str) -> str:
    """What makes two spans the same protected value."""
    return f"{kind}:{DIGIT.sub('', value) if kind in ('card', 'phone') else value.lower()}"


def protected(kind: str, value: str) -> list[str]:
    """The entity of a span and its classes: domain and local part, the first three parts, all digits but four, the first six."""
    whole = entity(kind, value)
    if kind == "email":
        local, _, domain = whole.partition("@")
        return [whole, f"email:@{domain}", f"{local}@"]
    if kind == "ip":
        return [whole, whole[: whole.rindex(".") + 1]]
    head = whole[:-4] if kind == "phone" else whole[: len("card:") + 6]
    return [whole, head + "*"]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of every term of the text that meets no span."""
    merged: list[list[int]] = []
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for m in TERM.finditer(text):
        if _free(merged, *m.span()):
            yield m[0].lower(), *m.span()


def content(text: str, spans: list[tuple[str, int, int]]) -> int:
    """The same for documents that are copies: a hash of all their terms outside spans, in order."""
    h = hashlib.blake2b(digest_size=8)
    for t, _, _ in free_terms(text, spans):
        h.update(t.encode("utf-8", "surrogatepass") + b" ")
    return int.from_bytes(h.digest(), "little", signed=True)


def _free(merged: list[list[int]], start: int, end: int) -> bool:
    lo, hi = 0, len(merged)
    while lo < hi:
        mid = (lo + hi) // 2
        if merged[mid][1] <= start:
            lo = mid + 1
        else:
            hi = mid
    return lo == len(merged) or merged[lo][0] >= end


SPANS = "array<struct<kind string, start long, end long>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
LONGS = pa.list_(pa.int64())


def _arrow(spans: list[list[tuple[str, int, int]]]) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], ARROW_SPANS)


def name_of(word: str) -> int:
    """64 bits for a term or entity."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), SEED) - (1 << 63)


def scanned(docs: DataFrame) -> DataFrame:
    """What one pass over docs (carried struct, text) finds, as rows of two kinds.

    A row for each document has what it carries and its base spans; one with spans also has its text, a key
    made of it, its entities by name, and a name that its copies share. Rows with a term hold in how many
    documents of a part of the corpus the term stands outside of spans.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["carried"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        last = None

        def counted() -> Iterator[pa.RecordBatch]:
            n = len(total)
            if n:
                empty = {c: pa.nulls(n, t) for c, t in (("carried", last), ("spans", ARROW_SPANS), ("key", pa.binary()), ("text", pa.string()), ("entities", LONGS), ("copy", pa.int64()))}
                yield pa.RecordBatch.from_pydict(empty | {"term": pa.array([name_of(t) for t in total], pa.int64()), "n": pa.array(total.values(), pa.int64())})
                total.clear()

        for b in batches:
            last, texts = b.column(0).type, b.column(1).to_pylist()
            spans = [base_spans(t) for t in texts]
            for t, x in zip(texts, spans, strict=True):
                total.update({w for w, _, _ in free_terms(t, x)} if x else {w.lower() for w in set(TERM.findall(t or ""))})
                if len(total) > HELD:
                    yield from counted()
            held = [(t, x) if x else None for t, x in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_pydict({
                "carried": b.column(0),
                "spans": _arrow(spans),
                "key": pa.array([h and hashlib.blake2b(h[0].encode("utf-8", "surrogatepass"), digest_size=16).digest() for h in held], pa.binary()),
                "text": pa.array([h and h[0] for h in held], pa.string()),
                "entities": pa.array([h and sorted({name_of(x) for k, s, e in h[1] for x in protected(k, h[0][s:e])}) for h in held], LONGS),
                "copy": pa.array([h and content(*h) for h in held], pa.int64()),
                "term": pa.nulls(len(b), pa.int64()),
                "n": pa.nulls(len(b), pa.int64()),
            })
        yield from counted()

    return docs.select("carried", "text").mapInArrow(run, f"carried {kind}, spans {SPANS}, key binary, text string, entities array<long>, copy long, term long, n long")


def most_documents(n: float, n_entity: Column | float, share: float) -> Column | float:
    """A term of more documents cannot disclose `share` of an entity's information, even if it is in all documents of the entity."""
    return n_entity * (n / n_entity) ** (1 - share) * (1 + 1e-9)


def disclosing(table_: DataFrame, share: float = DISCLOSED) -> DataFrame:
    """(key, wanted array<long>): for each text of scanned() the terms whose PMI with an entity of it is at least `share` of the entity's information.

    The two must have met in two documents that are not copies. Texts are taken once, with the number of their
    rows. Entities that stand in the same texts are judged as one (their texts' hashes say which), so that a list of
    addresses repeated elsewhere makes one row for each term, not one for each address and term. Terms in at least 1 in COMMON of all (term, document) pairs, so at most COMMON of them, are known to
    every task, so that most pairs that cannot count are never made.
    """
    spark = table_.sparkSession
    counts = table_.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n_term"))
    found = table_.where("term IS NULL")
    n = float(max(1, found.count()))
    texts = written(found.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.first("copy").alias("copy"), F.first("entities").alias("entities"), F.first("text").alias("text")), "private")
    held = texts.select("key", "copy", "n", F.explode("entities").alias("entity"))
    which = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"texts{k}") for k in (1, 2)]
    entities = held.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.min("copy").alias("lo"), F.max("copy").alias("hi"), *which).where("lo != hi")
    entities = kept(entities.select("entity", "n_entity", F.xxhash64("texts1", "texts2").alias("as_one")))
    one = looked_up(held.select("key", "entity"), entities, ["entity"], "n_entity").select("key", F.struct(F.col("as_one").alias("entity"), "n_entity").alias("e"))
    shared = one.groupBy("key").agg(F.collect_set("e").alias("shared"))  # of one text
    least = max(most_documents(n, 2.0, share), (table_.agg(F.sum("n")).first()[0] or 0) / COMMON)
    common = spark.sparkContext.broadcast(dict(map(tuple, counts.where(F.col("n_term") >= least).collect())))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for b in batches:
            for key, copy, rows, text, entities in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                terms = {name_of(t) for t in {t for t, _, _ in free_terms(text, base_spans(text))}}
                for e in entities:
                    most = most_documents(n, float(e["n_entity"]), share)
                    some = [t for t in terms if known.get(t, 0) <= most]
                    same = {"key": pa.array([key] * len(some), pa.binary())} | {c: pa.array([v] * len(some), pa.int64()) for c, v in (("copy", copy), ("n", rows), ("entity", e["entity"]), ("n_entity", e["n_entity"]))}
                    yield pa.RecordBatch.from_pydict(same | {"term": pa.array(some, pa.int64())})

    asked = texts.join(shared, "key").select("key", "copy", "n", "text", "shared")
    pairs = written(asked.mapInArrow(pair, "key binary, copy long, n long, entity long, n_entity long, term long"), "pairs")
    met = pairs.groupBy("entity", "n_entity", "term").agg(F.sum("n").alias("both"), F.min("copy").alias("lo"), F.max("copy").alias("hi")).where("lo != hi")
    information = F.log(F.lit(n) / F.col("n_entity"))
    mutual = F.log((F.col("both") * F.lit(n) / F.col("n_entity") + PRIOR) / (F.col("n_term") + PRIOR))
    judged = met.join(counts, "term").where((mutual > 1e-12) & (mutual >= share * information - 1e-12)).select("entity", "term", "both")
    return looked_up(pairs.select("key", "entity", "term"), kept(judged), ["entity", "term"], "both").groupBy("key").agg(F.collect_set("term").alias("wanted"))


def term_spans(text: str, spans: list[tuple[str, int, int]], wanted: list[int]) -> list[tuple[str, int, int]]:
    """Where the wanted terms stand outside of spans."""
    some, known = set(wanted), {}
    out = []
    for t, s, e in free_terms(text, spans):
        if t not in known:
            known[t] = name_of(t) in some
        if known[t]:
            out.append(("term", s, e))
    return out


def with_terms(table_: DataFrame, share: float) -> DataFrame:
    """The rows of scanned() that have spans, with the terms `wanted` of each."""
    return table_.where("key IS NOT NULL").join(disclosing(table_, share), "key", "left").select("carried", "text", "wanted")


def personal_data(docs: DataFrame, share: float = DISCLOSED) -> DataFrame:
    """(doc_id, spans) for every row of docs (doc_id, text): base spans by kind and start, then terms by start.

    Spans are (kind, start, end) in code points. A null or empty text has none. An entity is a value or a class of values (protected()). The base kinds are matched
    by their patterns alone; the method adds spans of kind `term`, none of which meets a base span. Repeated
    rows count as documents of their own in the estimates, but a term must have met an entity in two
    documents that differ in their terms to be judged, so copies of a document prove nothing. A disclosing
    term is a span wherever it stands in a document that holds its entity. No rows give no rows; other
    columns are ignored. docs is read once.
    """
    table_ = written(scanned(docs.select(F.struct("doc_id").alias("carried"), "text")), "scanned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, wanted in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                base = base_spans(text)
                out.append(base + (term_spans(text, base, wanted) if wanted else []))
            yield pa.RecordBatch.from_arrays([b.column(0), _arrow(out)], names=["carried", "spans"])

    kind = table_.schema["carried"].dataType.simpleString()
    found = with_terms(table_, share).mapInArrow(run, f"carried {kind}, spans {SPANS}")
    none = table_.where("term IS NULL AND key IS NULL").select("carried", "spans")
    return found.unionByName(none).select("carried.doc_id", "spans")


#: What takes the place of a span; a term becomes its class.
GENERAL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def sanitised(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span generalised; where spans overlap, one replacement stands for all, named by the first."""
    if not text or not spans:
        return text
    out, at, end, name = [], 0, -1, ""
    for kind, s, e in [*sorted(spans, key=lambda x: (x[1], -x[2])), ("", len(text) + 1, 0)]:
        if s < end:
            end = max(end, e)
            continue
        if end >= 0:
            out.append(name)
            at = end
        out.append(text[at:s])
        word = text[s:e]
        name = GENERAL.get(kind) or ("[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]")
        end = e
    return "".join(out)


def sanitise(docs: DataFrame, share: float = DISCLOSED) -> DataFrame:
    """docs with `text` sanitised; n_chars, where it is a column, follows the text. Null texts stay null.

    docs is read once. Rows without personal data pass as they are; only the others meet their terms in a join.
    """
    columns = docs.columns
    table_ = written(scanned(docs.select(F.struct(*columns).alias("carried"), "text")), "scanned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, wanted in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                base = base_spans(text)
                texts.append(sanitised(text, base + (term_spans(text, base, wanted) if wanted else [])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["carried", "text"])

    kind = table_.schema["carried"].dataType.simpleString()
    touched = with_terms(table_, share).mapInArrow(run, f"carried {kind}, text string").select(*("text" if c == "text" else f"carried.`{c}`" for c in columns))
    whole = table_.where("term IS NULL AND key IS NULL").select("carried.*").unionByName(touched)
    return whole.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else whole


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    n = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    base = _text(F.filter("spans", lambda s: s["kind"] != "term"))
    return found.select("doc_id", *n, F.sha2(base, 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))

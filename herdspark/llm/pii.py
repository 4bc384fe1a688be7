"""Personal data, and the terms that give it away.

Mail addresses, network addresses, card numbers and phone numbers are found by
their form. Each distinct value is a protected entity. The words of its documents
are its terms; their co-occurrence over the whole corpus tells how much a term
reveals: the pointwise mutual information of term and entity, as a share of the
entity's own information content. A share of one means that whoever reads the
term knows the entity even after the value itself is masked. Terms above the
disclosure thresholds are generalised or removed: in all documents of the entity,
wherever they stand, and those that reveal it by themselves in every document.

Co-occurrence is counted over distinct documents, and over the words near the
entity's mentions; the larger share counts. A term must be seen with the entity in
several different documents or surroundings, so copies of a text reveal nothing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdspark.llm.common import WORDS, bytes_of, fresh, slices, text_of, word_chunks
from herdspark.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: Characters to either side of a mention in which terms are gathered.
CONTEXT = 64
#: Different documents, or surroundings, in which a term must be seen with an entity.
MIN_SUPPORT = 3
#: Shares of the entity's information from which a term is generalised, and removed; a removed one reveals the entity by itself.
GENERALISE, REMOVE = 0.85, 0.95
#: Up to so many terms are given to the tasks that count or mark them; beyond, all words are counted or joined.
MAX_SHARED_TERMS = 200_000
#: Words of 64 bits that tell in which classes of documents a term occurs.
CLASSES = 8
#: Words whose documents a task counts before it forgets those met once; documents with values it holds back meanwhile.
HELD_WORDS, HELD_DOCUMENTS = 1_000_000, 2_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
#: Without one of these a text has no value.
_VALUE_BYTE, _VALUE = re.compile(rb"[0-9@]"), re.compile("[0-9@]")
# A match starts where a run of digits starts, as none ends inside one.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses; each ``@`` is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _number(part: str) -> int:
    """The value of a digit string, or 256 where it is surely above 255."""
    part = part.lstrip("0")
    return int(part or "0") if len(part) <= 3 else 256


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all values found by form, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_number(p) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdecimal() for c in m[0]) <= 15]
    return sorted(out)


def entity_of(text: str, start: int, kind: int, end: int) -> int:
    """A 64-bit name of a value: letters in lower case, numbers without separators."""
    value = text[start:end].lower() if kind == 0 else re.sub(r"[^0-9.]" if kind == 1 else r"[^0-9]", "", text[start:end])
    return int.from_bytes(hashlib.blake2b(f"{KINDS[kind]}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def nearby_terms(text: str, spans: list[tuple[int, int, int]], context: int = CONTEXT) -> Iterator[tuple[int, int, str, int, int]]:
    """(entity, surroundings, term, start, end) for the whole words near each value, values left out."""
    taken = [(a, b) for a, _, b in spans]
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for start, kind, end in spans:
        low, high = max(0, start - context), min(len(text), end + context)
        # A word that the border cuts is left out.
        words = [m.span() for m in _TERM.finditer(text, low, high)]
        words = [
            (a, b) for a, b in words
            if (a > low or a == 0 or not _TERM.match(text[a - 1])) and (b < high or b == len(text) or not _TERM.match(text[b]))
        ]
        close = taken[bisect_right(ends, low) : bisect_left(starts, high)]
        words = [(a, b) for a, b in words if not any(a < t[1] and b > t[0] for t in close)]
        terms = [text[a:b].translate(_FOLD) for a, b in words]
        around = int.from_bytes(hashlib.blake2b(" ".join(terms).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
        entity = entity_of(text, start, kind, end)
        for (a, b), term in zip(words, terms, strict=True):
            yield entity, around, term, a, b


def words_outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the whole words that touch no value."""
    at, done = 0, 0
    values = sorted((a, b) for a, _, b in spans)
    for m in _TERM.finditer(text):
        start, end = m.span()
        while at < len(values) and values[at][0] < end:
            done = max(done, values[at][1])
            at += 1
        if start >= done:
            yield m[0].translate(_FOLD), start, end


_SPAN = "struct<start:bigint,kind:int,end:bigint>"
_TERM_TYPE = "struct<entity:bigint,around:bigint,term:string,start:bigint,end:bigint>"
#: Kinds of spans in the order in which those that start together are listed.
SPAN_KINDS = (*KINDS, "general", "removed")


def mentions(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(doc_id, sha, spans, terms, entities, row): the values of each whole text and the terms around them."""
    source = docs.select("doc_id", F.sha2(bytes_of(), 256).alias("sha"), text_of().alias("text"))
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    term = pa.struct([("entity", pa.int64()), ("around", pa.int64()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    names = [[f.name for f in kind] for kind in (span, term)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, terms, entities = [], [], []
            for text in slices(batch.column(2), 64):
                found = base_spans(text)
                spans.append([dict(zip(names[0], s, strict=True)) for s in found])
                terms.append([dict(zip(names[1], t, strict=True)) for t in nearby_terms(text, found, context)])
                entities.append(sorted({entity_of(text, *s) for s in found}))
            columns = [pa.array(spans, pa.list_(span)), pa.array(terms, pa.list_(term)), pa.array(entities, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns], ["doc_id", "sha", "spans", "terms", "entities"]
            )

    kinds = T.StructType.fromDDL(f"spans array<{_SPAN}>, terms array<{_TERM_TYPE}>, entities array<bigint>")
    schema = T.StructType([*source.schema.fields[:2], *kinds.fields])
    return source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def term_counts(docs: DataFrame, wanted: DataFrame, max_shared: int = MAX_SHARED_TERMS) -> DataFrame:
    """(term, n, least): occurrences in the whole corpus of the wanted terms; the empty term counts all words.

    ``least`` is a number of distinct documents that the term surely reaches
    outside values: how many of ``64 * CLASSES`` classes of text hashes have it, among
    texts without a digit or an ``@``. Tasks send one bit set a word, so nothing grows.

    Tasks count the words they read and send each word's sum once. If the wanted
    terms are few, tasks count only these; if not, all words, and the later join
    picks the wanted ones. The counts are the same.
    """
    few = [r[0] for r in wanted.select("term").limit(max_shared + 1).collect()]
    chosen = frozenset(t.encode() for t in few) if len(few) <= max_shared else None
    shared = docs.sparkSession.sparkContext.broadcast(chosen)
    source = docs.select(bytes_of().alias("raw"))
    names = [f"b{k}" for k in range(CLASSES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = shared.value
        counts: Counter[bytes] = Counter()
        classes: dict[bytes, int] = {}
        total = 0

        def flush() -> pa.RecordBatch:
            words = [w.decode("utf-8", "replace") for w in counts]
            bits = [np.frombuffer(classes.get(w, 0).to_bytes(8 * CLASSES, "little"), "<i8") for w in counts]
            bits = np.array(bits, np.int64).reshape(-1, CLASSES)
            columns = [pa.array(list(counts.values()), pa.int64()), *(pa.array(bits[:, k]) for k in range(CLASSES))]
            counts.clear()
            classes.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *columns], ["term", "n", *names])

        for batch in batches:
            for raw in slices(batch.column(0), 64):
                here: set[bytes] = set()
                for words in word_chunks(raw, WORDS):
                    total += len(words)
                    words = words if chosen is None else list(filter(chosen.__contains__, words))
                    counts.update(words)
                    here.update(words)
                if here and not _VALUE_BYTE.search(raw):
                    one = 1 << zlib.crc32(raw) % (64 * CLASSES)
                    for word in here:
                        classes[word] = classes.get(word, 0) | one
                if len(counts) > 200_000:
                    yield flush()
        yield flush()
        none = [pa.array([0], pa.int64())] * CLASSES
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([total], pa.int64()), *none], ["term", "n", *names])

    counted = source.mapInArrow(run, "term string, n bigint, " + ", ".join(f"{name} bigint" for name in names))
    least = sum((F.bit_count(F.bit_or(name)) for name in names), F.lit(0)).cast("bigint")
    return counted.groupBy("term").agg(F.sum("n").alias("n"), least.alias("least"))


def disclosing_near(
    docs: DataFrame, rows: DataFrame, min_support: int = MIN_SUPPORT, least: float = GENERALISE, max_shared: int = MAX_SHARED_TERMS
) -> DataFrame:
    """(entity, term, share) of the terms that reveal at least ``least`` of an entity's information.

    Of N words in the corpus n_e stand near the entity; the term occurs n_t times,
    n_te of them near the entity. PMI = log2(N n_te / (n_t n_e)), the entity's
    information is log2(N / n_e), and the share is their ratio.
    """
    near = rows.select("row", F.explode("terms").alias("x")).select("row", "x.*")
    counted = near.groupBy("entity", "term").agg(
        F.countDistinct("around").alias("support"), F.count(F.lit(1)).alias("n_te")
    )
    joint = cut_lineage(counted.filter(F.col("support") >= min_support))
    counts = cut_lineage(term_counts(docs, joint.select("term").distinct(), max_shared))
    total = counts.filter("term = ''").agg(F.sum("n")).first()[0] or 1
    size = near.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    words = F.lit(float(total))
    # A word near two mentions of one entity is one occurrence.
    gained = F.log2(words * F.least("n_te", "n") / (F.col("n") * F.col("n_e")))
    share = F.try_divide(gained, F.log2(words / F.col("n_e")))
    found = joint.join(counts, "term").join(size, "entity").withColumn("share", share)
    return found.filter(F.col("share") >= least).select("entity", "term", "share")


def _chosen(df: DataFrame, name: str, max_shared: int) -> set | None:
    """The distinct values of a column, or none if there are more than may be given to every task."""
    few = [r[0] for r in df.select(name).distinct().limit(max_shared + 1).collect()]
    return set(few) if len(few) <= max_shared else None


def chosen_words(text: str, chosen: frozenset[bytes] | None) -> list[tuple[str, int, int]]:
    """(term, start, end) of the chosen words outside values; most texts have none, which their split bytes tell."""
    if chosen is not None and all(chosen.isdisjoint(words) for words in word_chunks(text.encode("utf-8", "replace"), WORDS)):
        return []
    words = words_outside(text, base_spans(text))
    return [w for w in words if chosen is None or w[0].encode("utf-8", "replace") in chosen]


def most_documents(n_e: int, total: int, least: float) -> float:
    """No term of more documents than this reveals ``least`` of an entity that stands in ``n_e`` of ``total``."""
    return n_e * (total / n_e) ** (1 - least) * (1 + 1e-9)


def pairs_in_documents(
    docs: DataFrame, size: DataFrame, total: int, least: float = GENERALISE, max_shared: int = MAX_SHARED_TERMS
) -> DataFrame:
    """(entity, term, n_te): distinct documents with both, for the entities of ``size``; a null entity stands for any of them.

    Only documents that hold such an entity give their terms, once however many
    copies there are. A task leaves out terms that it alone meets in too many
    distinct documents to reveal any entity of the document, so common words make
    no pairs.
    """
    few = {r[0]: most_documents(r[1], total, least) for r in size.select("entity", "n_e").limit(max_shared + 1).collect()}
    few = few if len(few) <= max_shared else None
    shared = docs.sparkSession.sparkContext.broadcast(few)
    source = docs.select(F.sha2(bytes_of(), 256).alias("sha"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held: list[tuple[str, list[int], set[str]]] = []
        documents: Counter[bytes] = Counter()
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            rows = []
            for sha, entities, terms in held:
                most = None if known is None else max(known[e] for e in entities)
                rows.append((sha, entities, sorted(t for t in terms if most is None or documents[t.encode("utf-8", "replace")] <= most)))
            held.clear()
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["sha", "entities", "terms"])

        for batch in batches:
            for sha, text in zip(batch.column(0).to_pylist(), slices(batch.column(1), 64), strict=True):
                mark = int(sha[:32], 16)
                if mark in seen:
                    continue
                seen.add(mark)
                if not _VALUE.search(text):
                    if known is not None:
                        documents.update({w for words in word_chunks(text.encode("utf-8", "replace"), WORDS) for w in words})
                    if len(documents) > HELD_WORDS:
                        documents = Counter({w: n for w, n in documents.items() if n > 1})
                    continue
                spans = base_spans(text)
                found = {entity_of(text, *s) for s in spans}
                found = found if known is None else found & known.keys()
                if found:
                    held.append((sha, sorted(found), {t for t, _, _ in words_outside(text, spans)}))
                if len(held) > HELD_DOCUMENTS:
                    yield flush()
        yield flush()

    found = source.mapInArrow(run, "sha string, entities array<bigint>, terms array<string>").dropDuplicates(["sha"])
    if few is None:
        held = found.select("sha", "terms", F.explode("entities").alias("entity")).join(size.select("entity"), "entity", "left_semi")
        held = held.groupBy("sha").agg(F.first("terms").alias("terms"), F.collect_list("entity").alias("entities"))
        found = held.select("sha", "entities", "terms")
    any_of = F.array(F.lit(None).cast("bigint"))
    held = found.select(F.explode(F.concat(any_of, "entities")).alias("entity"), "terms")
    return held.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te"))


def document_frequencies(docs: DataFrame, wanted: DataFrame, max_shared: int = MAX_SHARED_TERMS) -> DataFrame:
    """(term, n_t): distinct documents in which each wanted term stands outside values.

    Documents give the wanted terms they hold; copies are known by their digests.
    If too many terms are wanted to be given to every task, all terms are counted.
    """
    few = _chosen(wanted, "term", max_shared)
    shared = docs.sparkSession.sparkContext.broadcast(None if few is None else frozenset(t.encode() for t in few))
    source = docs.select(F.sha2(bytes_of(), 256).alias("sha"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = shared.value
        for batch in batches:
            rows, terms = [], []
            for row, text in enumerate(slices(batch.column(1), 64)):
                found = {t for t, _, _ in chosen_words(text, chosen)}
                if found:
                    rows.append(row)
                    terms.append(sorted(found))
            sha = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([sha, pa.array(terms, pa.list_(pa.string()))], ["sha", "terms"])

    found = source.mapInArrow(run, "sha string, terms array<string>").dropDuplicates(["sha"])
    return found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def disclosing_in_documents(
    docs: DataFrame, rows: DataFrame, min_support: int = MIN_SUPPORT, least: float = GENERALISE, max_shared: int = MAX_SHARED_TERMS
) -> DataFrame:
    """(entity, term, share) of the terms that reveal an entity by the distinct documents they share with it.

    Of N distinct documents n_e hold the entity, n_t the term and n_te both; the
    share is that of ``disclosing_near``. As a term stands in no more documents of
    an entity than there are, entities below the support are left out at once, and
    only terms that may reach the share with some entity are counted over all documents.
    """
    texts = cut_lineage(rows.groupBy("sha").agg(F.first("entities").alias("entities")))
    held = texts.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    size = cut_lineage(held.filter(F.col("n_e") >= min_support))
    joint = size.select("entity", F.lit("").alias("term"), F.lit(0).alias("n_te")).limit(0)
    if not size.isEmpty():
        counts = cut_lineage(pairs_in_documents(docs, size, texts.count(), least, max_shared).filter(F.col("n_te") >= min_support))
        joint = counts.filter("entity IS NOT NULL")
    if joint.isEmpty():
        return joint.select("entity", "term", F.lit(0.0).alias("share"))
    total = F.lit(float(texts.count()))

    def share(term_documents: str) -> Column:
        gained = F.log2(total * F.col("n_te") / (F.col(term_documents) * F.col("n_e")))
        return F.try_divide(gained, F.log2(total / F.col("n_e")))

    # A term stands in no fewer documents than in those of the entities: what fails by these need not be counted.
    least_known = counts.filter("entity IS NULL").select("term", F.col("n_te").alias("known"))
    joint = joint.join(least_known, "term").join(size, "entity").filter(share("known") >= least - 1e-9)
    joint = cut_lineage(joint.drop("known"))
    met = term_counts(docs, joint.select("term").distinct(), max_shared).filter("least > 0").select("term", "least")
    joint = joint.join(met, "term", "left").withColumn("least", F.greatest(F.coalesce("least", F.lit(1)), "n_te"))
    joint = cut_lineage(joint.filter(share("least") >= least - 1e-9).drop("least"))
    alone = document_frequencies(docs, joint, max_shared)
    found = joint.join(alone, "term").withColumn("share", share("n_t"))
    return found.filter(F.col("share") >= least).select("entity", "term", "share")


def disclosing_terms(
    docs: DataFrame, rows: DataFrame, min_support: int = MIN_SUPPORT, least: float = GENERALISE, max_shared: int = MAX_SHARED_TERMS
) -> DataFrame:
    """(entity, term, share) of the terms that reveal at least ``least`` of an entity's information, by either count."""
    either = disclosing_near(docs, rows, min_support, least, max_shared).unionByName(
        disclosing_in_documents(docs, rows, min_support, least, max_shared)
    )
    return either.groupBy("entity", "term").agg(F.max("share").alias("share"))


def occurrences(docs: DataFrame, telling: DataFrame, max_shared: int = MAX_SHARED_TERMS) -> DataFrame:
    """(doc_id, sha, spans, entities, hits, row): the values of each whole text and the places of disclosing terms.

    If these are many, the places of all words; the join with ``telling`` picks the same.
    """
    few = _chosen(telling, "term", max_shared)
    shared = docs.sparkSession.sparkContext.broadcast(None if few is None else frozenset(t.encode() for t in few))
    source = docs.select("doc_id", F.sha2(bytes_of(), 256).alias("sha"), text_of().alias("text"))
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    hit = pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    names = [[f.name for f in kind] for kind in (span, hit)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = shared.value
        for batch in batches:
            spans, entities, hits = [], [], []
            for text in slices(batch.column(2), 64):
                found = base_spans(text)
                spans.append([dict(zip(names[0], s, strict=True)) for s in found])
                entities.append(sorted({entity_of(text, *s) for s in found}))
                hits.append([dict(zip(names[1], w, strict=True)) for w in chosen_words(text, chosen)])
            columns = [pa.array(spans, pa.list_(span)), pa.array(entities, pa.list_(pa.int64())), pa.array(hits, pa.list_(hit))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns], ["doc_id", "sha", "spans", "entities", "hits"]
            )

    kinds = T.StructType.fromDDL(f"spans array<{_SPAN}>, entities array<bigint>, hits array<struct<term:string,start:bigint,end:bigint>>")
    schema = T.StructType([*source.schema.fields[:2], *kinds.fields])
    return source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def all_spans(
    docs: DataFrame, context: int = CONTEXT, min_support: int = MIN_SUPPORT, generalise: float = GENERALISE,
    remove: float = REMOVE, max_shared: int = MAX_SHARED_TERMS,
) -> DataFrame:
    """(doc_id, sha, base, found): per document the spans found by form, and those with the disclosing terms.

    A term is marked wherever it stands in the documents of its entity; from a
    share of ``remove`` on in all documents.
    """
    source = docs.select("doc_id", "text")
    rows = cut_lineage(mentions(source, context))
    telling = cut_lineage(disclosing_terms(source, rows, min_support, generalise, max_shared))
    if telling.isEmpty():
        return rows.select("doc_id", "sha", F.col("spans").alias("base"), F.col("spans").alias("found"))
    rows = cut_lineage(occurrences(source, telling, max_shared))
    places = rows.select("row", "entities", F.explode("hits").alias("x")).select("row", "entities", "x.*")
    own = (F.col("share") >= remove) | F.array_contains(F.col("entities"), F.col("entity"))
    kind = F.when(F.max("share") >= remove, len(KINDS) + 1).otherwise(len(KINDS))
    terms = places.join(telling, "term").filter(own).groupBy("row", "start", "end").agg(kind.cast("int").alias("kind"))
    per_row = terms.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    more = F.coalesce("more", F.array().cast(f"array<{_SPAN}>"))
    return rows.join(per_row, "row", "left").select(
        "doc_id", "sha", F.col("spans").alias("base"), F.array_sort(F.concat("spans", more)).alias("found")
    )


def _shown(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in SPAN_KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def scan(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms), one row per document.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then
    by the order of the kinds. Null text counts as empty. Repeated rows, and rows
    without id, are answered each. An empty table gives no rows.
    """
    found = all_spans(docs, **settings)
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_shown(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _shown(F.col("found")).alias("spans"),
        (F.size("found") - F.size("base")).cast("bigint").alias("n_terms"),
    )


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Values become their kind in brackets, generalised terms ``[TERM]``; removed ones go. Overlaps go once."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], "" if kind == len(KINDS) + 1 else "[TERM]" if kind == len(KINDS) else f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """The documents with personal data masked and disclosing terms generalised or removed; all columns kept."""
    found = all_spans(docs, **settings).filter(F.size("found") > 0)
    key, mark, spans = fresh(docs, "key"), fresh(docs, "mark"), fresh(docs, "spans")
    # Rows that share id and text have the same spans.
    one = found.groupBy("doc_id", "sha").agg(F.first("found").alias(spans))
    one = one.select(F.col("doc_id").alias(mark), F.col("sha").alias(key), spans)
    sha = F.sha2(bytes_of(), 256)
    joined = docs.join(one, (sha == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(mark)), "left")

    def mask(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in columns:
            rows = zip(slices(texts, 64), found.to_pylist(), strict=True)
            yield pa.array([t if not f else masked(t, [(s["start"], s["kind"], s["end"]) for s in f]) for t, f in rows], pa.string())

    changed = F.arrow_udf(mask, T.StringType())
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(changed(text_of(), F.col(spans)))
    return joined.withColumn("text", text).select(*docs.columns)

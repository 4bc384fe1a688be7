"""License scanning by diagonal voting.

Every rolling word k-gram of a text that occurs in a license template is joined
with the positions it has there. A pair of positions votes for the diagonal
"place in the text minus place in the template"; an undisturbed quotation puts
all its votes on one diagonal, an added or lost word moves the rest to a
neighbouring one. Diagonals a few words apart are merged, and a merged span is
verified by the share of the template's words that its k-grams cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdspark.llm.common import WORDS, bytes_of, slices, word_chunks
from herdspark.session import cut_lineage

#: The phrases whose places are counted, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices by which a text states its license, as words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
)
K = 3
#: Diagonals at most so many words apart belong to one quotation.
DRIFT = 2
#: The share of a template's words that a span must cover.
MIN_COVERAGE = 0.75


def template_grams(templates, k: int = K) -> list[tuple[int, str, int, int, str]]:
    """(template, label, its words, position, k-gram) of all templates; a shorter one is a gram by itself."""
    out = []
    for number, (label, text) in enumerate(templates):
        words = text.split()
        if len(words) < k:
            raise ValueError(f"template {text!r} is shorter than {k} words")
        out += [(number, label, len(words), i, " ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
    return out


class Finder:
    """Places of the phrases and of the templates' k-grams in a text."""

    def __init__(self, grams: set[str], phrases=PHRASES, k: int = K):
        self.k = k
        self.grams = {tuple(g.encode().split()): g for g in grams}
        self.phrases = {tuple(p.encode().split()): label for p, label in phrases}
        self.sizes = sorted({len(p) for p in self.phrases})
        self.reach = max(k, *self.sizes) if self.sizes else k
        self.first = frozenset([p[0] for p in self.phrases] + [g[0] for g in self.grams])

    def find(self, raw: bytes) -> tuple[int, list[int], set[str], list[tuple[int, str]]]:
        """(words, starts of phrases, their labels, (place, k-gram) of the templates' k-grams)."""
        done, starts, labels, grams = 0, [], set(), []
        words: list[bytes] = []
        for more in _with_end(word_chunks(raw, WORDS)):
            last = more is None
            words += more or []
            # Places whose longest phrase would reach beyond the words read so far wait for the next chunk.
            stop = len(words) if last else max(0, len(words) - self.reach + 1)
            flags = bytes(map(self.first.__contains__, words[:stop]))
            at = flags.find(1)
            while at >= 0:
                for size in self.sizes:
                    label = self.phrases.get(tuple(words[at : at + size]))
                    if label and at + size <= len(words):
                        starts.append(done + at)
                        labels.add(label)
                gram = self.grams.get(tuple(words[at : at + self.k]))
                if gram:
                    grams.append((done + at, gram))
                at = flags.find(1, at + 1)
            done += stop
            words = words[stop:]
        return done, starts, labels, grams


def _with_end(chunks: Iterator[list[bytes]]) -> Iterator[list[bytes] | None]:
    yield from chunks
    yield None


ROW_SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("places", T.ArrayType(T.LongType())), T.StructField("grams", T.ArrayType(T.StringType())),
    ]
)


def found_grams(docs: DataFrame, grams: set[str], phrases=PHRASES, k: int = K) -> DataFrame:
    """Per document: word count, places of the phrases, and the k-grams that some template holds."""
    source = docs.select("doc_id", bytes_of().alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(grams, phrases, k).find
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string())]
        for batch in batches:
            rows = []
            for raw in slices(batch.column(1), 64):
                n, starts, labels, hits = find(raw)
                ends = (min(starts), max(starts)) if starts else (None, None)
                rows.append((n, len(starts), *ends, sorted(labels), [p for p, _ in hits], [g for _, g in hits]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                ["doc_id", *ROW_SCHEMA.names],
            )

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], *ROW_SCHEMA.fields]))


def quotations(rows: DataFrame, positions: DataFrame, k: int = K, drift: int = DRIFT) -> DataFrame:
    """(row, label, start, end, coverage) of merged diagonals, from (row, places, grams) and template positions.

    ``positions`` is as small as the templates. Votes are summed per diagonal
    before they are merged; a span holds no more template positions than the
    template has.
    """
    at = rows.select("row", F.explode(F.arrays_zip("places", "grams")).alias("x")).select(
        "row", F.col("x.places").alias("place"), F.xxhash64("x.grams").alias("hash"), F.col("x.grams").alias("gram")
    )
    # The templates are a parameter of bounded size, checked by the caller.
    templates = F.broadcast(positions.withColumn("hash", F.xxhash64("t_gram")))
    votes = at.join(templates, "hash").filter("gram = t_gram").withColumn("diagonal", F.col("place") - F.col("position"))
    diagonals = votes.groupBy("row", "template", "diagonal").agg(
        F.first("label").alias("label"), F.first("words").alias("words"), F.collect_set("position").alias("covered")
    )
    in_order = Window.partitionBy("row", "template").orderBy("diagonal")
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_order) > drift, F.lit(True))
    merged = (
        diagonals.withColumn("opens", opens.cast("int"))
        .withColumn("span", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "template", "span")
        .agg(
            F.first("label").alias("label"), F.first("words").alias("words"),
            F.min(F.col("diagonal") + F.array_min("covered")).alias("start"),
            (F.max(F.col("diagonal") + F.array_max("covered")) + k).alias("end"),
            F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"),
        )
    )
    # The words that the k-grams at these positions cover.
    shown = F.array_distinct(F.flatten(F.transform("covered", lambda p: F.sequence(p, p + (k - 1)))))
    return merged.select("row", "label", "start", "end", (F.size(shown) / F.col("words")).alias("coverage"))


#: More templates than this would have to be joined with a shuffle.
MAX_TEMPLATE_GRAMS = 100_000


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, k: int = K, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one row per document.

    ``labels`` joins the phrases' labels and those of verified quotations;
    ``score`` is the best coverage of a template, 1 where a phrase stands, 0 where
    nothing is found; ``spans`` are ``label:first:end`` in words. Null text has no words.
    Repeated rows, and rows without id, are answered each; an empty table gives no rows.
    """
    grams = template_grams(templates, k)
    if len(grams) > MAX_TEMPLATE_GRAMS:
        raise ValueError("too many templates for one table of positions")
    positions = docs.sparkSession.createDataFrame(grams, "template int, label string, words int, position bigint, t_gram string")
    rows = cut_lineage(
        found_grams(docs, {g[-1] for g in grams}, phrases, k).withColumn("row", F.monotonically_increasing_id())
    )
    spans = quotations(rows.filter(F.size("places") > 0), positions, k)
    kept = F.col("coverage") >= min_coverage
    per_row = spans.groupBy("row").agg(
        F.max("coverage").alias("best"),
        F.array_sort(F.collect_set(F.when(kept, F.col("label")))).alias("quoted"),
        F.array_sort(F.collect_set(F.when(kept, F.struct("start", "end", "label")))).alias("spans"),
    )
    none = F.array().cast("array<string>")
    shown = F.transform(F.col("spans"), lambda s: F.concat_ws(":", s["label"], s["start"], s["end"]))
    return rows.join(per_row, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce("quoted", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce(F.array_join(shown, ","), F.lit("")).alias("spans"),
    )


def check_sql(templates=TEMPLATES, phrases=PHRASES, k: int = K, drift: int = DRIFT, min_coverage: float = MIN_COVERAGE) -> str:
    """The same result in DuckDB SQL, for the query's check."""
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    base = " UNION ALL ".join(
        f"SELECT rid, place, '{label}' AS label FROM grams WHERE array_to_string(w[place + 1:place + {len(p.split())}], ' ') = '{p}' AND place + {len(p.split())} <= len(w)"
        for p, label in phrases
    )
    values = ", ".join(f"({t}, '{label}', {n}, {i}, '{g}')" for t, label, n, i, g in template_grams(templates, k))
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM documents),
    grams AS (SELECT rid, w, unnest(range(len(w))) AS place FROM d),
    base AS MATERIALIZED ({base}),
    t(template, label, words, position, gram) AS (VALUES {values}),
    votes AS (SELECT DISTINCT rid, template, label, words, position, place - position AS diagonal
        FROM (SELECT rid, place, array_to_string(w[place + 1:place + {k}], ' ') AS gram FROM grams WHERE place + {k} <= len(w)) JOIN t USING (gram)),
    diagonals AS (SELECT DISTINCT rid, template, diagonal FROM votes),
    opened AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > {drift} THEN 1 ELSE 0 END AS opens FROM diagonals),
    merged AS (SELECT *, sum(opens) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM opened),
    covered AS (SELECT rid, template, label, words, span, place, diagonal + position AS spot FROM votes JOIN merged USING (rid, template, diagonal), unnest(range(position, position + {k})) AS u(place)),
    spans AS (SELECT rid, template, label, span, count(DISTINCT place) / any_value(words) AS coverage, min(spot) AS start, max(spot) + {k} AS stop FROM covered GROUP BY ALL),
    quoted AS (SELECT rid, max(coverage) AS best FROM spans GROUP BY rid),
    shown AS (SELECT rid, string_agg(label || ':' || start || ':' || stop, ',' ORDER BY start, stop, label) AS spans FROM (SELECT DISTINCT rid, label, start, stop FROM spans WHERE coverage >= {min_coverage}) GROUP BY rid),
    labelled AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION SELECT rid, label FROM spans WHERE coverage >= {min_coverage}) GROUP BY rid),
    counted AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
        CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score, coalesce(spans, '') AS spans
    FROM d LEFT JOIN counted USING (rid) LEFT JOIN labelled USING (rid) LEFT JOIN quoted USING (rid) LEFT JOIN shown USING (rid)
    """

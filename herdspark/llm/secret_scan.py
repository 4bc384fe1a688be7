"""Secret scanning by linking the parts of a credential.

Strong patterns (an assigned secret, an access key, a long hex run) are reported
by themselves. Weaker parts are found as well: identifiers (logins, mail
addresses), opaque tokens, and endpoints (addresses of services). A weak part is
reported only if a complementary part lies within its scope, a fixed number of
characters to either side: an identifier or an endpoint needs a secret, an opaque
token needs an identifier or an endpoint. The link is an interval join over
scope-sized bins of each text; it asks whether a partner exists and never lists
pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdspark.llm.common import text_of
from herdspark.session import cut_lineage

SCOPE = 160


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


@dataclass(frozen=True)
class Part:
    """A pattern; ``group`` must have ``least`` characters; ``needs`` are patterns the match must hold."""

    kind: str
    role: str
    pattern: str
    strong: bool = False
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()
    #: A text without this string has no match: saves the scan.
    hint: str = ""
    #: The same pattern for the JVM, where a plain one would recurse or try every place of a long run: loops are
    #: possessive, and a match begins where a run does or the last match ended. It finds the same matches.
    jvm: str = ""


_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: In the order in which spans that start together are listed.
PARTS = (
    Part("assign", "secret", f"({_either_case('password')}|{_either_case('passwd')}|{_either_case('secret')}|{_either_case('token')}|{_either_case('api')}_?{_either_case('key')}){_VALUE}([A-Za-z0-9+/_.=-]+)", True, 2, 8),
    Part("access", "identifier", "AKIA[A-Z0-9]+", True, 0, 16, hint="AKIA"),
    Part("hex", "secret", "[0-9a-f]{32,}", True),
    Part("login", "identifier", f"({_either_case('username')}|{_either_case('user')}|{_either_case('login')}|{_either_case('account')}|{_either_case('client')}_?{_either_case('id')}){_VALUE}([A-Za-z0-9@._-]+)", group=2, least=3),
    Part("email", "identifier", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", hint="@", jvm=r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Part("opaque", "opaque", "[A-Za-z0-9+/_=-]{16,}", needs=("[0-9]", "[A-Z]", "[a-z]")),
    Part("url", "endpoint", r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+""", hint="://"),
    Part("address", "endpoint", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(:[0-9]{1,5})?"),
)
KINDS = tuple(p.kind for p in PARTS)
BASE = tuple(p.kind for p in PARTS if p.strong)
#: Which roles complete a weak part of a role.
COMPLEMENTS = {"identifier": ("secret", "opaque"), "endpoint": ("secret", "opaque"), "opaque": ("identifier", "endpoint")}


def _matches(text: Column, number: int, part: Part) -> Column:
    """Per match: kind, place among the matches, characters before it since the last, its length, whether it counts."""
    pattern = part.jvm or part.pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(part.group)) if part.group else found
    between = F.split(text, pattern, -1)
    both = F.arrays_zip(found.alias("match"), measured.alias("value"), F.slice(between, 1, F.size(found)).alias("gap"))

    def one(x: Column, i: Column) -> Column:
        ok = F.char_length(x["value"]) >= part.least
        for need in part.needs:
            ok = ok & x["match"].rlike(need)
        return F.struct(
            F.lit(number).alias("kind"), i.alias("place"),
            F.char_length(x["gap"]).alias("gap"), F.char_length(x["match"]).alias("size"), ok.alias("ok"),
        )

    none = F.array().cast("array<struct<kind:int,place:int,gap:int,size:int,ok:boolean>>")
    possible = text.contains(part.hint) if part.hint else text.rlike(pattern)
    return F.when(possible, F.transform(both, one)).otherwise(none)


def parts_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of every document, and (row, kind, start, end) of every part found."""
    text = text_of()
    arrays = [_matches(text, i, part) for i, part in enumerate(PARTS)]
    rows = cut_lineage(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*arrays).alias("found"))
    )
    in_order = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    parts = (
        rows.select("row", F.explode("found").alias("x")).select("row", "x.*")
        .withColumn("end", F.sum(F.col("gap") + F.col("size")).over(in_order))
        .filter("ok")
        .select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    )
    return rows.select("row", "doc_id"), parts


def _near(left: DataFrame, right: DataFrame, scope: int, how: str) -> DataFrame:
    """Interval semi or anti join: is a right interval within ``scope`` characters of the left one?

    Both sides are dealt by (row, bin). A left interval asks in the bins its
    scope touches, a right one stands in the bins it touches.
    """
    width = max(scope, 1)
    bins = lambda a, b: F.sequence(F.floor(a / width), F.floor(b / width))
    there = right.select(
        F.col("row").alias("r_row"), F.col("role").alias("r_role"), F.col("start").alias("r_start"), F.col("end").alias("r_end"),
        F.explode(bins(F.col("start"), F.col("end"))).alias("r_bin"),
    )
    asked = left.withColumn("bin", F.explode(bins(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope)))
    complement = F.lit(False)
    for role, partners in COMPLEMENTS.items():
        complement = complement | ((F.col("role") == role) & F.col("r_role").isin(*partners))
    close = (
        (F.col("row") == F.col("r_row")) & (F.col("bin") == F.col("r_bin"))
        & (F.col("r_start") <= F.col("end") + scope) & (F.col("r_end") >= F.col("start") - scope)
    )
    if how == "covered":
        close = close & (F.col("r_start") < F.col("end")) & (F.col("r_end") > F.col("start"))
    else:
        close = close & complement
    return asked.join(there, close, "left_semi").drop("bin").distinct()


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The strong parts, and the weak ones that have a complementary part in scope.

    A weak part that overlaps a strong one says nothing new and is left out.
    """
    role = F.element_at(F.array(*[F.lit(p.role) for p in PARTS]), F.col("kind") + 1)
    known = cut_lineage(parts.withColumn("role", role))
    strong = F.col("kind") < len(BASE)
    weak = known.filter(~strong)
    own = weak.join(_near(weak, known.filter(strong), 1, "covered"), ["row", "kind", "start", "end", "role"], "left_anti")
    own = cut_lineage(own)
    partners = known.filter(strong).unionByName(own)
    return known.filter(strong).unionByName(_near(own, partners, scope, "complement"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked), one row per document.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then by
    the order of the kinds. Null text counts as empty. Repeated rows, and rows
    without id, are answered each. An empty table gives no rows.
    """
    rows, parts = parts_of(docs.select("doc_id", "text"))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    shown = F.concat_ws(":", name, F.col("start"), F.col("end"))
    per_row = linked_parts(parts, scope).groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.count(F.when(F.col("kind") >= len(BASE), 1)).alias("n_linked"),
        F.sort_array(F.collect_list(F.struct("start", "kind", shown.alias("shown")))).alias("found"),
    )
    joined = rows.join(per_row, "row", "left")
    none = F.array().cast(per_row.schema["found"].dataType)
    found = F.coalesce("found", none)
    texts = lambda a: F.array_join(F.transform(a, lambda x: x["shown"]), ",")
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(texts(F.filter(found, lambda x: x["kind"] < len(BASE))).cast("binary"), 256).alias("base_sha256"),
        texts(found).alias("spans"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
    )


def check_sql(scope: int = SCOPE) -> str:
    """The same result in DuckDB SQL, for the query's check."""
    found = []
    for i, part in enumerate(PARTS):
        p = part.pattern.replace("'", "''")
        needs = "".join(f" AND regexp_matches(m, '{n}')" for n in part.needs)
        found.append(
            f"""SELECT rid, {i} AS kind, unnest(range(len(ms))) AS place, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g, '{part.role}' AS role,
            {part.least} AS least FROM (SELECT rid, regexp_extract_all(t, '{p}', 0) AS ms,
            regexp_extract_all(t, '{p}', {part.group}) AS vs, string_split_regex(t, '{p}') AS gs FROM d)"""
        )
        found[-1] = f"SELECT rid, kind, role, place, length(m) AS size, length(g) AS gap, length(v) >= least{needs} AS ok FROM ({found[-1]})"
    names = ", ".join(f"'{k}'" for k in KINDS)
    roles = " OR ".join(f"(l.role = '{r}' AND r.role IN ({', '.join(repr(c) for c in cs)}))" for r, cs in COMPLEMENTS.items())
    strong = len(BASE)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({' UNION ALL '.join(found)}),
    placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY rid, kind ORDER BY place) AS stop FROM m),
    parts AS (SELECT rid, kind, role, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE ok),
    own AS (SELECT * FROM parts l WHERE kind < {strong} OR NOT EXISTS (SELECT 1 FROM parts r WHERE r.rid = l.rid AND r.kind < {strong} AND r.start < l.stop AND r.stop > l.start)),
    linked AS (SELECT * FROM own l WHERE kind < {strong} OR EXISTS (SELECT 1 FROM own r WHERE r.rid = l.rid AND ({roles}) AND r.start <= l.stop + {scope} AND r.stop >= l.start - {scope})),
    shown AS (SELECT rid, kind, start, ([{names}])[kind + 1] || ':' || start || ':' || stop AS s FROM linked),
    sums AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(BASE))}, count(*) FILTER (kind >= {strong}) AS n_linked,
        string_agg(s, ',' ORDER BY start, kind) FILTER (kind < {strong}) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans FROM shown GROUP BY rid)
    SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
    FROM d LEFT JOIN sums USING (rid)
    """

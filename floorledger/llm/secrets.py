"""Secrets in texts: strong patterns, and weak parts that only count beside their complement.

Three strong kinds are always reported: assignments to secret-like names, access identifiers, and long hexadecimal
runs.  Three weak kinds are too common alone: account names (``ident``), mixed base64-like runs (``blob``) and URLs
(``endpoint``).  They are joined by interval with what completes them in the same text: an account name with a secret,
a run with an identifier, a URL with both, no more than ``reach`` characters away.  The parts of a text are swept in
order of their start, so each part meets the nearest one on either side and no pairs are listed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorledger.llm.joins import free_name, text_key, with_listed
from floorledger.llm.scratch import stored

REACH = 200


@dataclass(frozen=True)
class Kind:
    """A match counts when its group has at least ``least`` characters and the match finds all of ``also``.

    Roles: identifier, secret, endpoint.
    """

    name: str
    pattern: str
    group: int
    least: int
    role: str
    strong: bool
    also: tuple[str, ...] = ()


# The strong patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, LEAST_ACCESS = r"AKIA[A-Z0-9]", 18
HEX, LEAST_HEX = r"[0-9a-f]", 16

# A run that is longer than asked from its start is the same run as any run of at least that length.
KINDS = (
    Kind("assign", ASSIGN, 2, 12, "secret", True),
    Kind("access", ACCESS + "{%d,}" % (LEAST_ACCESS - len("AKIA")), 0, LEAST_ACCESS, "identifier", True),
    Kind("hex", HEX + "{%d,}" % LEAST_HEX, 0, LEAST_HEX, "secret", True),
    Kind("ident", r"""((?i:user|username|login|account|client_id|access_key_id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""",
         2, 3, "identifier", False),
    # An equals sign only ends a run, so that a name before it is not part of its value.
    Kind("blob", r"[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32, "secret", False, ("[0-9]", "[A-Z]", "[a-z]")),
    Kind("endpoint", r"""https?://[^\x00-\x20"'<>]+""", 0, 12, "endpoint", False),
)
STRONG = tuple(kind.name for kind in KINDS if kind.strong)
# The row that stands for a text itself among its parts.
TEXT = -1

_ROW = ["doc_id", "key"]


def _matches(text: Column, number: int, kind: Kind) -> Column:
    """Lengths of each match, of its group, and of the text since the match before.

    Splitting and extracting scan in the same way, so piece and match alternate.
    """
    pattern = F.lit(kind.pattern)
    steps = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(kind.group)).alias("value"),
    )

    def counting(step: Column) -> Column:
        """Length of the group, 0 where the match does not count."""
        fits = reduce(lambda a, b: a & b, [step["match"].rlike(extra) for extra in kind.also], F.lit(True))
        return F.when(fits, F.length(step["value"])).otherwise(0) if kind.also else F.length(step["value"])

    lengths = F.transform(
        F.filter(steps, lambda step: step["match"].isNotNull()),
        lambda step: F.struct(
            F.lit(number).alias("kind"),
            F.length(step["gap"]).alias("gap"),
            F.length(step["match"]).alias("size"),
            counting(step).alias("value"),
        ),
    )
    return F.when(text.rlike(kind.pattern), lengths)


def _of(test) -> Column:
    numbers = [number for number, kind in enumerate(KINDS) if test(kind)]
    return F.col("kind").isin(numbers)


def secret_parts(documents: DataFrame, reach: int = REACH) -> DataFrame:
    """``doc_id, key, copies, kind, start, end, reported``: every part of every text, and one row of kind -1 per text.

    Positions are code points, end exclusive.  ``key`` tells texts of one doc_id apart; equal rows are one text with
    ``copies``.  Null text counts as empty.  A text's parts stay together, so memory follows its own number of parts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.array(
        F.struct(F.lit(TEXT).alias("kind"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(0).alias("value"))
    )
    none = F.filter(own, lambda step: F.lit(False))
    matches = [_matches(F.col("text"), number, kind) for number, kind in enumerate(KINDS)]
    found = F.concat(own, *[F.coalesce(steps, none) for steps in matches])
    texts = documents.select(F.col("doc_id").cast("long"), text.alias("text"))
    steps = texts.select("doc_id", text_key(F.col("text")).alias("key"), F.posexplode(found).alias("pos", "step"))
    steps = steps.select(*_ROW, "pos", "step.*").repartition(*_ROW)
    steps = steps.groupBy(*_ROW, "pos", "kind", "gap", "size", "value").agg(F.count(F.lit(1)).alias("copies"))

    so_far = Window.partitionBy(*_ROW, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.get(F.array(*[F.lit(kind.least) for kind in KINDS]), F.col("kind"))
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    placed = (
        steps.withColumn("end", end)
        .where((F.col("kind") == TEXT) | (F.col("value") >= least))
        .select(*_ROW, "copies", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    )

    in_order = Window.partitionBy(*_ROW).orderBy("start", "kind", "end")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)

    def marked(name: str, test: Column, frame: DataFrame) -> DataFrame:
        """Ends of the last such part before and start of the next one after."""
        frame = frame.withColumn(f"{name}_at", F.when(test & (F.col("kind") != TEXT), F.col("start")))
        return frame.withColumn(
            f"{name}_before", F.max(F.when(F.col(f"{name}_at").isNotNull(), F.col("end"))).over(before)
        ).withColumn(
            f"{name}_after",
            F.expr(f"lead({name}_at, 1) ignore nulls over (partition by doc_id, key order by start, kind, end)"),
        )

    swept = marked("identifier", _of(lambda kind: kind.role == "identifier"), placed)
    swept = marked("secret", _of(lambda kind: kind.role == "secret"), swept)
    swept = marked("strong", _of(lambda kind: kind.strong), swept)

    def beside(name: str, most: int) -> Column:
        gaps = (F.col("start") - F.col(f"{name}_before"), F.col(f"{name}_after") - F.col("end"))
        return F.coalesce(gaps[0] <= most, F.lit(False)) | F.coalesce(gaps[1] <= most, F.lit(False))

    identified, kept_secret = beside("identifier", reach), beside("secret", reach)
    role = F.get(F.array(*[F.lit(kind.role) for kind in KINDS]), F.col("kind"))
    complete = (
        F.when(role == "identifier", kept_secret).when(role == "secret", identified).otherwise(identified & kept_secret)
    )
    strong = _of(lambda kind: kind.strong)
    # What lies wholly in a strong part is reported with it; what sticks out of one is reported itself.
    inside = F.coalesce(F.col("strong_before") >= F.col("end"), F.lit(False))
    reported = F.when(F.col("kind") == TEXT, False).when(strong, True).otherwise(complete & ~inside)
    return swept.select(*_ROW, "copies", "kind", "start", "end", reported.alias("reported"))


def _listed(test: Column) -> Column:
    """kind:start:end of the parts that pass, by start, then kind."""
    parts = F.array_sort(F.collect_list(F.when(test, F.struct("start", "kind", "end"))))
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    named = lambda part: F.concat_ws(":", F.get(names, part["kind"]), part["start"], part["end"])
    return F.array_join(F.transform(parts, named), ",")


def secrets(documents: DataFrame, reach: int = REACH) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row; without a part, counts are 0 and
    ``spans`` is empty."""
    parts = secret_parts(documents, reach)
    counts = [
        F.count(F.when(F.col("kind") == number, 1)).alias(f"n_{kind.name}")
        for number, kind in enumerate(KINDS)
        if kind.strong
    ]
    rows = parts.groupBy(*_ROW).agg(
        *counts,
        F.sha2(_listed(_of(lambda kind: kind.strong)), 256).alias("base_sha256"),
        _listed(F.col("reported")).alias("spans"),
        F.max(F.when(F.col("kind") == TEXT, F.col("copies"))).alias("copies"),
    )
    columns = ["doc_id", *[f"n_{name}" for name in STRONG], "base_sha256", "spans"]
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*columns)


def redacted(
    documents: DataFrame, mark: str = "[SECRET]", reach: int = REACH, count: str = "redactions"
) -> DataFrame:
    """All rows and columns, every reported part of ``text`` replaced by ``mark``, and how many were, in a last column.

    That column is named ``count``, with as many underscores after it as make it a new name.  Parts that overlap or touch
    are replaced as one.  Only texts with parts are joined; see ``joins`` for how.  Null text stays null.
    """
    parts = secret_parts(documents, reach).where("reported").select(*_ROW, "start", "end").distinct()
    before = Window.partitionBy(*_ROW).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    so_far = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    apart = F.when(F.col("start") <= F.col("so_far"), 0).otherwise(1)
    islands = parts.withColumn("so_far", F.max("end").over(before)).withColumn("island", F.sum(apart).over(so_far))
    spans = islands.groupBy(*_ROW, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    listed = stored(
        spans.groupBy(*_ROW).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("parts"))
    )
    joined = with_listed(documents, listed.select(F.col("doc_id"), "key", "parts"))
    text, parts_ = F.col("row.text").cast("string"), F.col("listed.parts")
    ends = F.concat(F.array(F.lit(0)), F.transform(parts_, lambda part: part["end"].cast("int")))
    starts = F.concat(F.transform(parts_, lambda part: part["start"].cast("int")), F.array(F.length(text)))
    between = F.transform(
        F.arrays_zip(ends.alias("from"), starts.alias("to")),
        lambda gap: F.substring(text, gap["from"] + 1, gap["to"] - gap["from"]),
    )
    cleaned = F.when(parts_.isNull(), text).otherwise(F.array_join(between, mark))
    return joined.select(
        *[cleaned.alias(name) if name == "text" else F.col(f"row.`{name}`") for name in documents.columns],
        F.coalesce(F.size(parts_), F.lit(0)).alias(free_name(documents.columns, count)),
    )

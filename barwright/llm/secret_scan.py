"""Secret scans with corpus-wide ownership frequency, as DataFrame expressions only.

Every text is scanned for assigned secrets, access keys and hexadecimal strings, which are
always reported, and for further strings that look like credentials (long, of mixed
characters). The hashes of all these candidates are counted over the corpus by distinct
repositories and owners: a value that ``example_owners`` owners or ``example_repositories``
repositories hold is a widely copied example, any other looks live. Equal texts count once,
under the first of their owners and repositories, so a copied document is not one more owner. Further strings are
reported only if they look live and don't overlap a base span.

Places come from the lengths of matches and of the pieces between them, added up in lists of
``PIECE`` at a time, so a text of many matches takes little more than its share.

Defined results: null texts are empty; null repositories and owners count as one more of
each; rows with equal id and text share one result each; rows may repeat; an empty table
gives an empty table; other columns aren't returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.arrow import quoted
from barwright.session import cut

#: Kinds in order of report with their patterns.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
FOUND = "array<struct<start:int,kind:int,end:int,hash:string>>"


#: Matches, or findings, that lists grow by at a time.
PIECE = 256


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(steps: Column, state: dict[str, Column], kind: str, step: Callable[[Column, Column], tuple[dict[str, Column], Column]], use: Callable[[Column, Callable[[str], Column]], Column]) -> Column:
    """``use`` of what a fold over ``steps`` lists, and of its last state by name.

    ``step`` gives the next state and a list to add; lists are put together by pieces.
    """
    names = list(state)
    pair = lambda values, lists: F.struct(*[values[n].alias(n) for n in names], lists.alias("lists"))
    none = F.array().cast(kind)

    def one(a: Column, s: Column) -> Column:
        values, more = step(a, s)
        return pair(values, F.concat(a["lists"], more))

    def piece(a: Column, part: Column) -> Column:
        return _once(F.aggregate(part, pair({n: a[n] for n in names}, none), one), lambda done: pair({n: done[n] for n in names}, F.concat(a["lists"], F.array(done["lists"]))))

    def whole(steps: Column) -> Column:
        last = F.floor((F.size(steps) - 1) / PIECE).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(steps, i * PIECE + 1, F.lit(PIECE)))
        return _once(F.aggregate(parts, pair(state, F.array().cast(f"array<{kind}>")), piece), lambda done: use(F.flatten(done["lists"]), lambda n: done[n]))

    return _once(steps, whole)


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Places of the pattern's matches, leftmost and non-overlapping; those whose ``group`` is short are then dropped.

    Between the matches lie the pieces that splitting gives, so lengths add up to places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.zip_with(found, value, lambda m, v: F.struct(F.length(m).alias("size"), F.length(v).alias("chars"), F.sha2(v, 256).alias("hash")))
    steps = F.zip_with(gaps, sizes, lambda g, m: F.struct(g.alias("gap"), m["size"].alias("size"), m["chars"].alias("chars"), m["hash"].alias("hash")))
    steps = F.filter(steps, lambda s: s["size"].isNotNull())  # one gap more than matches

    def step(a: Column, s: Column) -> tuple[dict[str, Column], Column]:
        begin = a["at"] + s["gap"]
        end = begin + s["size"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), s["hash"].alias("hash"))
        return {"at": end}, F.when(s["chars"] >= least, F.array(span)).otherwise(F.array().cast(FOUND))

    return F.when(text.rlike(pattern), _folded(steps, {"at": F.lit(0)}, FOUND, step, lambda lists, _: lists)).otherwise(F.array().cast(FOUND))


def candidates(text: Column) -> Column:
    """All candidate spans of a text; further ones must mix digits and both cases."""
    text = F.coalesce(text, F.lit(""))
    mixed = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z]){TOKEN}"
    return F.concat(_spans(text, ASSIGN, 0, group=2, least=12), _spans(text, ACCESS, 1), _spans(text, HEX, 2), _spans(text, mixed, 3))


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", repository: Column | None = None, owner: Column | None = None, example_owners: int = 3, example_repositories: int = 4) -> DataFrame:
    """(id, key, findings): findings are array<struct<start, kind, end, owners, repositories, live>> in order of report.

    ``key`` hashes id and text, to join with the documents; ``owner`` and ``repository`` default
    to the columns source and source with lang.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", owner, F.col("lang")) if repository is None else repository
    name, body = F.col(quoted(id)), F.col(quoted(text))
    rows = cut(docs.select(name.alias("scan_id"), F.xxhash64(name, body).alias("key"), F.xxhash64(body).alias("copy"), F.coalesce(owner, F.lit("\0")).alias("owner"), F.coalesce(repository, F.lit("\0")).alias("repository"), candidates(body).alias("found")))
    each = rows.where(F.size("found") > 0).select("key", "copy", "owner", "repository", F.explode("found").alias("c")).select("key", "copy", "owner", "repository", "c.*")
    # equal texts count once; after the first step a value in every document is a row for each repository
    held = each.groupBy("hash", "copy").agg(F.min("owner").alias("owner"), F.min("repository").alias("repository")).select("hash", "owner", "repository").distinct()
    counted = held.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    live = (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)
    judged = each.select("key", "start", "kind", "end", "hash").distinct().join(counted, "hash").withColumn("live", live)
    # in order of place, a further string overlaps a base span if one before ends after its start, or one after starts before its end
    order = Window.partitionBy("key").orderBy("start", "kind")
    base = F.col("kind") < 3
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start")
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing)) < F.col("end")
    overlaps = F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))
    kept = judged.withColumn("overlaps", overlaps).where(base | (F.col("live") & ~F.col("overlaps")))
    by_row = kept.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories", "live"))).alias("findings"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,owners:bigint,repositories:bigint,live:boolean>>")
    return rows.select("scan_id", "key").join(by_row, "key", "left").select(F.col("scan_id").alias(id), "key", F.coalesce("findings", empty).alias("findings"))


def redact(text: Column, findings: Column, mask: str = "[REDACTED]") -> Column:
    """The text with each run of overlapping findings replaced by ``mask``.

    The text is cut into stretches of ``PIECE`` findings first, so that a cut inside one doesn't
    count through all that comes before.
    """
    def stretches(body: Column, found: Column) -> Column:
        """Each stretch's first place, and its findings; runs of overlapping ones were merged before."""
        last = F.floor((F.size(found) - 1) / PIECE).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.element_at(found, (i * PIECE).cast("int"))["end"]).alias("begin"), F.slice(found, i * PIECE + 1, F.lit(PIECE)).alias("findings")))

    def merged(a: Column, f: Column) -> tuple[dict[str, Column], Column]:
        """Runs that end where the next begins after them; the open one is the state."""
        fresh = f["start"] >= a["end"]
        run = F.struct(a["start"].alias("start"), a["end"].alias("end"))
        return {"start": F.when(fresh, f["start"]).otherwise(a["start"]), "end": F.greatest(a["end"], f["end"])}, F.when(fresh & (a["end"] >= 0), F.array(run)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    def cut(body: Column, runs: Column) -> Column:
        def masked(s: Column) -> Column:
            size = F.element_at(s["findings"], -1)["end"] - s["begin"]

            def pieces(local: Column) -> Column:
                before = lambda f, k: F.when(k == 0, s["begin"]).otherwise(F.element_at(s["findings"], F.greatest(k, F.lit(1)))["end"])
                return F.array_join(F.transform(s["findings"], lambda f, k: F.concat(F.substring(local, before(f, k) - s["begin"] + 1, f["start"] - before(f, k)), F.lit(mask))), "")

            return _once(F.substring(body, s["begin"] + 1, size), pieces)

        rest = F.substring(body, F.element_at(runs, -1)["end"] + 1, F.length(body))
        return F.concat(F.array_join(F.transform(stretches(body, runs), masked), ""), rest)

    state = {"start": F.lit(-1), "end": F.lit(-1)}
    runs = _folded(findings, state, "array<struct<start:int,end:int>>", merged, lambda lists, last: F.concat(lists, F.array(F.struct(last("start").alias("start"), last("end").alias("end")))))
    return F.when(F.size(findings) == 0, text).otherwise(_once(F.struct(text.alias("body"), runs.alias("runs")), lambda x: cut(x["body"], x["runs"])))

"""Plans of imports and exports: what would be copied where, as tables."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical, kind_of, stem
from ..sources.shared import settled
from .filters import named_tags
from .ranking import placed, primary_location

#: Largest archive member and archive; titles listed in the credits of a group; archive extensions; folders by kind.
MOST_MEMBER, MOST_ARCHIVE, LISTED = 512 << 20, 8 << 30, 20
ARCHIVES = ("zip",)
FOLDERS = {"image": "Images", "model3d": "Models", "audio": "Audio", "reference": "References"}


def plan_import(incoming: DataFrame, asset: DataFrame, location: DataFrame) -> DataFrame:
    """Files (path, content_hash) with action: skipped (unknown kind), duplicate (content known and present), imported."""
    here = location.where("present").select("asset_id").distinct()
    known = asset.join(here, asset["id"] == here["asset_id"], "left_semi").select(F.col("content_hash").alias("_h"), F.col("id").alias("duplicate_of"))
    rows = incoming.join(known, F.col("content_hash") == F.col("_h"), "left").drop("_h")
    return rows.withColumn("action", F.when(kind_of("path").isNull(), "skipped").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("imported"))


def filter_members(listing: DataFrame) -> DataFrame:
    """Archive members (archive, ord, name, size, is_dir) with relative path and verdict.

    ok, unsafe path, hidden, nested archive, unknown, too large, or beyond the archive's limit: the members that are
    otherwise fine count towards it in order, and the first to pass it stops the rest.
    """
    flat = F.regexp_replace("name", r"\\", "/")
    parts = F.filter(F.split(flat, "/"), lambda p: (p != "") & (p != "."))
    unsafe = flat.rlike("^(/|[A-Za-z]:)") | F.array_contains(parts, "..")
    hidden = F.exists(parts, lambda p: p.startswith(".") | (p == "__MACOSX"))
    rel = F.array_join(parts, "/")
    ext = F.lower(F.regexp_extract(rel, r"\.([^./]+)$", 1))
    first = F.when(unsafe, "unsafe path").when(hidden, "hidden").when(ext.isin(*ARCHIVES), "nested archive").when(kind_of(rel).isNull(), "unknown").when(F.col("size") > MOST_MEMBER, "too large").otherwise("ok")
    rows = listing.where("not is_dir and name <> ''").withColumns({"relative": rel, "verdict": first})
    total = F.sum(F.when(F.col("verdict") == "ok", F.col("size")).otherwise(0)).over(Window.partitionBy("archive").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_total", total)
    return rows.withColumn("verdict", F.when(F.col("_total") > MOST_ARCHIVE, "beyond the limit").otherwise(F.col("verdict"))).drop("_total")


def strip_shared_folder(members: DataFrame) -> DataFrame:
    """Members with the folder taken off that all of an archive's members lie in."""
    head = F.split_part("relative", F.lit("/"), F.lit(1))
    deep = F.contains("relative", F.lit("/"))
    shared = members.groupBy(F.col("archive").alias("_a")).agg(((F.count_distinct(head) == 1) & F.bool_and(deep)).alias("_strip"))
    return members.join(shared, F.col("archive") == F.col("_a")).withColumn("relative", F.when(F.col("_strip"), F.regexp_replace("relative", "^[^/]*/", "")).otherwise(F.col("relative"))).drop("_a", "_strip")


def batch_label(path: str | Column, is_dir: str | Column) -> Column:
    """The tag of an import: an archive's or a folder's name, canonical, else ``dropped``."""
    path, is_dir = (F.col(c) if isinstance(c, str) else c for c in (path, is_dir))
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "[^/]*$", 0)
    named = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).isin(*ARCHIVES) | is_dir
    return F.coalesce(F.when(named, F.nullif(canonical(stem(name)), F.lit(""))), F.lit("dropped"))


class _Names:
    """The names taken in one family, and where its numbered ones go on."""

    def __init__(self, scheme: str) -> None:
        self.scheme, self.taken, self.tried = scheme, {}, {}
        self.after: dict[tuple[str, int], int] = {}  # a number that is taken, and one to try instead
        self.held: dict[tuple[str, str], list[int]] = {}  # the numbers that a content has, in order

    def target(self, name: str, digest: str) -> tuple[str, bool]:
        """The name that a content gets, and whether it is a new one."""
        if (name, digest) in self.tried:
            return self.tried[name, digest], False
        target = name
        if self.taken.get(name, digest) != digest:
            stem, dot, ext = name.rpartition(".")
            stem, ext = (stem, dot + ext) if stem else (name, "")
            head, dash, tail = stem.rpartition("-")
            numbered = self.scheme == "export" and dash and tail.isdecimal()
            head, first = (head, int(tail) + 1) if numbered else (stem, 1)
            free, at = self._free(head + "|" + ext, first, lambda n: f"{head}-{n}{ext}" in self.taken), self.held.get((head + "|" + ext, digest), [])
            same = at[k] if (k := bisect_left(at, first)) < len(at) else free
            number = min(free, same)
            target = f"{head}-{number}{ext}"
        fresh = target not in self.taken
        self._take(target, digest)
        self.tried[name, digest] = target
        return target, fresh

    def _take(self, target: str, digest: str) -> None:
        if target in self.taken:
            return
        self.taken[target] = digest
        stem, dot, ext = target.rpartition(".")
        stem, ext = (stem, dot + ext) if stem else (target, "")
        head, dash, tail = stem.rpartition("-")
        if dash and tail.isdecimal() and str(int(tail)) == tail:
            insort(self.held.setdefault((head + "|" + ext, digest), []), int(tail))

    def _free(self, run: str, number: int, taken: Callable[[int], bool]) -> int:
        """The first number of a run from ``number`` on that no name has; what was passed points on."""
        passed = []
        while True:
            if (run, number) in self.after:
                passed.append(number)
                number = self.after[run, number]
            elif taken(number):
                passed.append(number)
                number += 1
            else:
                break
        for n in passed:
            self.after[run, n] = number
        return number


def resolve_names(rows: DataFrame, scheme: str = "export") -> DataFrame:
    """Files (folder, name, content_hash, ord) with target and fresh: the same name and content is written once.

    Other content under a name taken gets the next free one: ``export`` raises a trailing number, ``import`` appends
    to the stem. ``ord`` is different for every row. Names that could meet lie in one family (a folder, a stem without
    trailing numbers, an extension). Of a name and content only the first row is numbered, the others follow it. In a
    family of a single name, as a flat export of "image.png" is, the numbers are those of an order that Spark ranges
    over many tasks, and the place in it is the number. Only families of several names, which take numbers from each
    other, are probed in order, each by itself, in time in proportion to their different names and contents.
    """
    family = F.concat_ws("|", "folder", F.lower(F.regexp_replace(stem("name"), "(-[0-9]+)+$", "")), F.regexp_extract("name", r"(?<=.)(\.[^.]*)$", 1))
    keyed = rows.select(family.alias("family"), "folder", "name", "content_hash", F.col("ord").cast("long").alias("ord"))
    first = settled(keyed.groupBy("family", "folder", "name", "content_hash").agg(F.min("ord").alias("ord")))
    tail = F.regexp_extract(_bare("name"), r"-(\p{Nd}+)$", 1)
    plain = F.bool_and(tail.rlike("^[0-9]{0,18}$"))  # longer numbers are raised one by one
    kinds = first.groupBy("family").agg((F.min("name") == F.max("name")).alias("one"), plain.alias("plain")).select("family", (F.col("one") & F.col("plain")).alias("single"))
    sorted_ = settled(first.join(kinds, "family"))
    named = _ranked_names(sorted_.where("single"), scheme).unionByName(_probed_names(sorted_.where("not single"), scheme))
    same = lambda c: keyed[c].eqNullSafe(F.col(f"n.{c}"))
    out = keyed.join(named.alias("n"), same("folder") & same("name") & same("content_hash"))
    return out.select(keyed["folder"], keyed["name"], keyed["content_hash"], keyed["ord"], "n.target", (F.col("n.fresh") & (keyed["ord"] == F.col("n.ord"))).alias("fresh"))


def _bare(name: str) -> Column:
    """A name without its extension; a name that only begins with a point has none."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")


def _ranked_names(first: DataFrame, scheme: str) -> DataFrame:
    """Targets of families of one name: the first content keeps it, the k-th after it has a number k further."""
    order = placed(first.select("family", "folder", "name", "content_hash", "ord"), F.asc("family"), F.asc("ord"), name="_place")
    start = order.groupBy("family").agg(F.min("_place").alias("_start"))
    k, bare = F.col("_place") - F.col("_start"), _bare("name")
    ext = F.substring("name", F.char_length(bare) + 1, F.char_length("name"))
    tail = F.regexp_extract(bare, "-([0-9]+)$", 1)
    appended = F.concat(bare, F.lit("-"), k.cast("string"), ext)
    raised = F.concat(F.regexp_replace(bare, "[0-9]+$", ""), (F.when(tail != "", tail).cast("long") + k).cast("string"), ext)
    target = F.when(k == 0, F.col("name")).when((tail != "") & F.lit(scheme == "export"), raised).otherwise(appended)
    return order.join(start, "family").select("folder", "name", "content_hash", "ord", target.alias("target"), F.lit(True).alias("fresh"))


def _probed_names(first: DataFrame, scheme: str) -> DataFrame:
    """Targets of families of several names, in order."""
    import pyarrow as pa

    kinds = "folder string, name string, content_hash string, ord long, target string, fresh boolean"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names = None, _Names(scheme)
        for batch in batches:
            out, new = [], []
            for fam, name, digest in zip(*[batch.column(k).to_pylist() for k in (0, 2, 3)], strict=True):
                if fam != now:
                    now, names = fam, _Names(scheme)
                target, fresh = names.target(name, digest)
                out.append(target)
                new.append(fresh)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string()), pa.array(new, pa.bool_())], names=["folder", "name", "content_hash", "ord", "target", "fresh"])

    keyed = first.select("family", "folder", "name", "content_hash", "ord")
    return keyed.repartition("family").sortWithinPartitions("family", "ord").mapInArrow(probe, kinds)


def export_plan(catalog, collection_id: int, layout: str = "flat") -> DataFrame:
    """Members of a set with action (reference, missing, copied, unchanged), folder and target, in the set's order."""
    if layout not in ("flat", "kind"):
        raise ValueError(f"unknown layout {layout!r}")
    members = catalog.collection_asset.where(F.col("collection_id") == collection_id).select(F.col("asset_id").alias("id"), "position")
    source = primary_location(catalog.location, present_only=True).select(F.col("asset_id").alias("id"), "abs_path")
    rows = members.join(catalog.asset.select("id", "kind", "content_hash"), "id").join(source, "id", "left")
    folder = F.lit("")
    for kind, name in FOLDERS.items() if layout == "kind" else ():
        folder = F.when(F.col("kind") == kind, name).otherwise(folder)
    rows = rows.withColumns({"folder": folder, "name": F.regexp_extract("abs_path", "[^/]*$", 0)})
    files = rows.where("kind <> 'reference' and abs_path is not null")
    placed = resolve_names(files.select("folder", "name", "content_hash", F.col("position").alias("ord"))).select(F.col("ord").alias("position"), "target", "fresh")
    out = rows.join(placed, "position", "left")
    action = F.when(F.col("kind") == "reference", "reference").when(F.col("abs_path").isNull(), "missing").when(F.col("fresh"), "copied").otherwise("unchanged")
    return out.select("id", "position", "folder", F.col("abs_path").alias("source"), "target", action.alias("action"))


def manifest(catalog, ids: DataFrame | None = None) -> DataFrame:
    """What an export tells of each item: its fields, sorted tags and file."""
    items = catalog.asset if ids is None else catalog.asset.join(ids.select("id"), "id", "left_semi")
    tags = named_tags(catalog).groupBy(F.col("asset_id").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("tags"))
    files = primary_location(catalog.location, present_only=True).select(F.col("asset_id").alias("id"), F.regexp_extract("abs_path", "[^/]*$", 0).alias("file"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = items.join(tags, "id", "left").join(files, "id", "left")
    return rows.select("id", "kind", "title", "content_hash", blank("source_name"), blank("source_url"), blank("license"), blank("caption"), blank("notes"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "file")


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def credits(entries: DataFrame) -> DataFrame:
    """A row for each source and licence: heading, url, the first LISTED titles and how many more; then one for each reference.

    entries: ord, kind, title, source_name, license, source_url. Sections: 0 with a source or licence, 1 without, 2
    references, in which ``place`` is the entry's ord. No group is gathered whole.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = entries.select("ord", "kind", "title", text("source_url").alias("url"), text("source_name").alias("source"), text("license").alias("license"))
    named = rows.where("kind <> 'reference' or kind is null").withColumn("section", F.when((F.col("source") == "") & (F.col("license") == ""), 1).otherwise(0))
    keys = ["section", "source", "license"]
    counts = named.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(F.when(F.col("url") != "", F.col("url")), F.when(F.col("url") != "", F.col("ord"))).alias("url"))
    first = named.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where(F.col("_r") <= LISTED)
    titles = first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "title"))), lambda s: s["title"]).alias("titles"))
    heading = F.when(F.col("section") == 1, "No source or licence recorded").when(F.col("source") == "", "Unattributed").otherwise(F.col("source"))
    groups = counts.join(titles, keys).select("section", heading.alias("heading"), "license", F.when(F.col("section") == 0, F.coalesce("url", F.lit(""))).otherwise("").alias("url"), "n", F.array_join("titles", "\n").alias("titles"), F.greatest(F.col("n") - LISTED, F.lit(0)).cast("bigint").alias("more"), F.lit(None).cast("bigint").alias("place"))
    one = rows.where("kind = 'reference'").select(F.lit(2).alias("section"), F.lit("References").alias("heading"), F.lit("").alias("license"), F.lit("").alias("url"), F.lit(1).cast("bigint").alias("n"), "title", F.lit(0).cast("bigint").alias("more"), F.col("ord").cast("bigint").alias("place"))
    return groups.union(one)


def write_credits(rows: DataFrame, path: str) -> None:
    """The report as text, in order: a part for every so many rows, and no more than one where they are few."""
    first = F.col("section").isin(0, 1) | (F.col("_before") == 0)
    few = rows.where("section = 2").orderBy("place").limit(1).select(F.col("place").alias("_first"))
    marked = rows.join(F.broadcast(few), F.col("place") == F.col("_first"), "left").withColumn("_before", F.when(F.col("_first").isNotNull(), 0).otherwise(1)).drop("_first")
    head = F.when(first, F.concat(F.lit("## "), F.col("heading")))
    body = F.concat_ws("\n", head, F.when(F.col("license") != "", F.concat(F.lit("Licence: "), F.col("license"))), F.nullif(F.col("url"), F.lit("")), F.regexp_replace("titles", "(?m)^", "- "), F.when(F.col("more") > 0, F.format_string("- and %d more", "more")), F.when(F.col("section") < 2, F.lit("")))
    marked.orderBy("section", "heading", "license", "place").select(body.alias("value")).write.mode("overwrite").text(path)

"""Outlines of texts whose lines depend on lines before them.

The lines of a plan (E31) are read in the row of their text. In the others, what a line knows of the lines before it is the last value that one of them has set (a heading, the place of the last action, a reset). Such
values compose: the value at the end of a run of lines is that of its last setting line, or else that of the run before. ``carried`` uses
this to read lines by ranges of (document, line): each range is filled by itself and takes over, of the document that it begins within,
what earlier ranges end with. So a document of any length is read by many tasks, and a range hands on one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import bound
from .records import in_ranges

# ---- fixed values: cased letters, and the shapes of lines --------------------------------------------------
_CASED, _NOT_TITLE = r"[\p{Lu}\p{Ll}\p{Lt}]", r"(?<![\p{Lu}\p{Ll}\p{Lt}])\p{Ll}|(?<=[\p{Lu}\p{Ll}\p{Lt}])[\p{Lu}\p{Lt}]"
PILLAR, ACTION = r"^Pillar (I|II|III): (.*)", r"^•\s+(.*)"
COMPONENT = r"^- \*\*(.*?):\*\*"
SECTION_NUMBER = r"^\d{3}\.\d{3,}(-\d+)?(\s+[A-Z][^\n]+)?$"
NEAR, LARGE, SHORT = 4, 10, 80
# ----------------------------------------------------------------------------------------------------------


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line, before): the trimmed lines of each text with the trimmed line before, from 0 on; a null text has none."""
    cut = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    out = docs.where(F.col(text).isNotNull()).select(key, cut.alias("_lines")).select(key, F.posexplode("_lines").alias("pos", "line"), "_lines")
    return out.select(key, "pos", "line", F.coalesce(F.get("_lines", F.col("pos") - 1), F.lit("")).alias("before"), F.slice("_lines", F.col("pos") + 2, NEAR).alias("next"))


def carried(rows: DataFrame, key: str, order: str, **values: Column) -> DataFrame:
    """rows with columns of those names: each the last value that is not null up to and with the row, within its key.

    Rows of a key and order should be distinct; of a key that is null each row would fill the others, as of any other key.
    """
    cut = in_ranges(rows.withColumns(values), key, order)
    names = list(values)
    # Of each range only its last key can go on into the next, and a key that goes on is the next one's first.
    last = cut.groupBy("_range").agg(F.max(F.struct(F.col(key).isNotNull().alias("k"), F.col(key).alias("key"))).alias("m")).select("_range", F.col("m.key").alias("_key"))
    ends = cut.join(F.broadcast(last), "_range").where(F.col(key).eqNullSafe(F.col("_key"))).groupBy("_range", "_key").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(order))).alias(n) for n in names])
    # One row a range.
    w = W.partitionBy("_key").orderBy("_range")
    after = ends.select("_key", F.col("_range").alias("_from"), F.lead("_range").over(w).alias("_to"), *[F.last(n, ignorenulls=True).over(w).alias(f"_carried_{n}") for n in names])
    spans = after.select("_key", "_from", F.coalesce("_to", F.lit(1 << 30)).alias("_to"), *[f"_carried_{n}" for n in names])
    own = W.partitionBy("_range", key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    filled = cut.withColumns({n: F.last(n, ignorenulls=True).over(own) for n in names})
    on = filled[key].eqNullSafe(spans["_key"]) & (filled["_range"] > spans["_from"]) & (filled["_range"] <= spans["_to"])
    return filled.join(F.broadcast(spans), on, "left").select(*[F.coalesce(F.col(c), F.col(f"_carried_{c}")).alias(c) if c in names else filled[c] for c in filled.columns if c != "_range"])


def inventory(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, category, component, description) of a Markdown inventory: ``## `` categories with ``- **name:**`` components, and
    the other ``- `` lines after a component as its description, joined by a space.

    A category that comes again takes the place of the earlier one. Components before any category are left out, and so are
    description lines without a component in their category. pos is the component's line.
    """
    line = F.col("line")
    head, part, item = line.startswith("## "), line.startswith("- **"), line.startswith("- ")
    name = F.when(part & ~head & line.rlike(COMPONENT), F.trim(F.regexp_extract("line", COMPONENT, 1)))
    told = lines(docs, key, text).select(key, "pos", "line", F.when(head, F.struct(F.trim(F.replace(line, F.lit("## "), F.lit(""))).alias("name"), F.col("pos").alias("at"))).alias("_head"), name.alias("_name"))
    known = carried(told.where(head | item), key, "pos", _category=F.col("_head"), _component=F.when(F.col("_name").isNotNull(), F.struct(F.col("_name").alias("name"), F.col("pos").alias("at"))))
    inside = known.where(F.col("_category").isNotNull() & F.col("_component").isNotNull() & (F.col("_component.at") > F.col("_category.at")) & ~head)
    rows = inside.select(key, "pos", F.col("_category.name").alias("category"), F.col("_category.at").alias("_at"), F.col("_component.at").alias("_of"), F.col("_component.name").alias("component"), F.when(~part, F.trim(F.replace(line, F.lit("- "), F.lit("")))).alias("_told"))
    told = F.transform(F.sort_array(F.collect_list(F.when(F.col("_told").isNotNull(), F.struct("pos", "_told")))), lambda x: x["_told"])
    # Empty lines at the beginning of a description do not count.
    joined = F.regexp_replace(F.array_join(told, " "), r"^ +", "")
    found = rows.groupBy(key, "_of").agg(F.first("category").alias("category"), F.first("_at").alias("_at"), F.first("component").alias("component"), joined.alias("description"))
    again = known.where(head).groupBy(key, F.col("_category.name").alias("category")).agg(F.max("pos").alias("_at"))
    kept = found.alias("f").join(again.alias("a"), F.col(f"f.{key}").eqNullSafe(F.col(f"a.{key}")) & (F.col("f.category") == F.col("a.category")) & (F.col("f._at") == F.col("a._at")), "left_semi")
    return kept.select(key, F.col("_of").alias("pos"), "category", "component", "description")


def _titled(c: Column) -> Column:
    """Not empty, every word begins with a capital and goes on in small letters, and not all in capitals."""
    return (c != "") & ~c.rlike(_NOT_TITLE) & (c.rlike(r"[\p{Ll}\p{Lt}]") | ~c.rlike(_CASED))


#: Bytes of lines that a task gives on at once, about.
GIVEN = 1 << 24


def _bullets(key: str, kind: pa.DataType):
    """(key, lines, marks) of texts, marks a sum of 1 (pillar), 2 (action) and 4 (titled): a row for each action with the lines that it depends on."""
    text = pa.string()
    out = pa.schema([(key, kind), ("pos", pa.int32()), ("line", text), ("_pillar", text), ("_before", text), ("_section", text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b["lines"].offsets.to_numpy()
            lines = b["lines"].values.slice(ends[0], ends[-1] - ends[0])
            marks = b["marks"].flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(ends)
            at, start = np.arange(len(marks)), np.repeat(ends[:-1] - ends[0], sizes)
            pillar, action, titled = ((marks & n) > 0 for n in (1, 2, 4))
            follows = np.zeros(len(marks), bool)
            for n in range(1, NEAR + 1):
                follows[:-n] |= action[n:] & (start[n:] == start[:-n])
            name = titled & ~pillar
            heads = name & ~action & follows
            # The last line up to each that is of a kind; those of earlier texts count as none.
            last = lambda of: np.maximum.accumulate(np.where(of, at, -1)) if len(of) else at
            acts = np.flatnonzero(action)
            if not len(acts):
                continue
            begin, owner = start[acts], np.repeat(np.arange(len(sizes)), sizes)[acts]
            of, set_by, named = last(pillar)[acts], last(pillar | heads)[acts], last(name)
            headed = (set_by >= begin) & heads[set_by]
            # The first action after what set or ended the section looks back for all of them.
            first = acts[np.searchsorted(acts, np.maximum(set_by, begin))]
            found = np.where(first > begin, named[first - 1], -1)
            section = np.where(headed, set_by, found)
            joined = ~headed & (section > begin) & titled[section - 1]
            lengths = np.append(0, np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False)))
            pick = lambda i, ok: (np.where(ok, i, 0), ok)
            parts = [(acts, acts >= 0), pick(of, of >= begin), pick(section - 1, joined), pick(section, section >= begin)]
            bulk = np.cumsum(sum(np.where(ok, lengths[i + 1] - lengths[i], 0) for i, ok in parts)) // GIVEN
            # Many actions under a long line go in parts.
            for rows in np.split(np.arange(len(acts)), np.flatnonzero(np.diff(bulk)) + 1):
                cols = [lines.take(pa.array(i[rows], mask=~ok[rows])) for i, ok in parts]
                yield pa.RecordBatch.from_arrays([b[key].take(pa.array(owner[rows])).cast(kind), pa.array((acts - begin)[rows], pa.int32()), *[c.cast(text) for c in cols]], schema=out)

    return run


def pillar_actions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, pillar, section, action) of the bullet lines of a plan.

    A pillar line sets the pillar and ends the section. A titled line with a bullet among the four lines after it sets the section. A bullet
    without a section looks back, however far, for the last titled line that is no pillar, joined to the line before that one if it is titled too; that is
    then the section, or else ``Uncategorized``. A null text has no rows. A text is read in its row, in one pass, so no line moves.
    """
    kinds = lambda x: F.when(x.rlike(PILLAR), 1).otherwise(0) + F.when(x.rlike(ACTION), 2).otherwise(0) + F.when(_titled(x), 4).otherwise(0)
    cut = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    marked = bound(cut, lambda lines: F.struct(lines.alias("lines"), F.transform(lines, kinds).alias("marks")))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key), marked.alias("_marked")).select(key, "_marked.lines", "_marked.marks")
    kind = rows.schema[key].dataType
    found = rows.mapInArrow(_bullets(key, to_arrow_type(kind)), f"`{key}` {kind.simpleString()}, pos int, line string, _pillar string, _before string, _section string")
    name = F.concat(F.lit("Pillar "), F.regexp_extract("_pillar", PILLAR, 1), F.lit(": "), F.regexp_extract("_pillar", PILLAR, 2))
    section = F.concat(F.coalesce(F.concat("_before", F.lit(" ")), F.lit("")), "_section")
    return found.select(key, "pos", F.coalesce(name, F.lit("")).alias("pillar"), F.coalesce(section, F.lit("Uncategorized")).alias("section"), F.regexp_replace(F.regexp_extract("line", ACTION, 1), r"^\s+|\s+$", "").alias("action"))


def numbered_sections(boxes: DataFrame, key: str = "path") -> DataFrame:
    """(key, n, part, heading, content) of layout lines (key, page, line, text, size, bold): sections by numbered headings, and
    their (a), (b) parts.

    A heading is a line of three digits, a point and three or more, that is large, bold or short. It begins on its page and takes
    the whole pages up to the page of the next one; of several on a page the last takes it, the others are empty. A section with lines that
    begin with (a), (b) ... is cut at them: part 0 is the text before the first, parts are lettered in order. Equal headings of a page count once.
    Spaces are made single. Pages before the first heading are left out.
    """
    text = F.trim("text")
    heads = boxes.where(text.rlike(SECTION_NUMBER) & ((F.col("size") > LARGE) | F.col("bold") | (F.char_length(text) < SHORT)))
    single = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    heads = heads.groupBy(key, "page", single(text).alias("heading")).agg(F.min("line").alias("line"))
    pages = boxes.groupBy(key, "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("content"))
    # One row a page: its last heading opens the section that the page belongs to.
    opened = heads.groupBy(key, "page").agg(F.max(F.struct("line", "heading")).alias("h"))
    marks = pages.join(opened, [key, "page"], "left").withColumn("_h", F.when(F.col("h").isNotNull(), F.struct("page", "h.line")))
    owned = carried(marks.drop("h"), key, "page", _owner=F.col("_h")).where("_owner IS NOT NULL")
    bodies = owned.groupBy(key, "_owner.page", "_owner.line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("page").alias("p"), "content"))), lambda x: x["content"]), "\n").alias("content"))
    sections = heads.join(bodies, [key, "page", "line"], "left").withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("page", "line")))
    parts = F.split(F.trim(F.coalesce("content", F.lit(""))), r"(?m)^\([a-z]\)\s+", -1)
    rows = sections.select(key, "n", "heading", F.posexplode(parts).alias("part", "content"))
    name = F.when(F.col("part") > 0, F.concat("heading", F.lit(" ("), F.char((96 + F.col("part")).cast("long")), F.lit(")"))).otherwise(F.col("heading"))
    return rows.select(key, "n", "part", name.alias("heading"), single(F.col("content")).alias("content"))

"""From page text to chunks: lines, headings, sentences, budgets and packing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillion.functions import text as T


def lines_of(pages: DataFrame) -> DataFrame:
    """One row a line of a page, numbered from 0."""
    kept = [c for c in pages.columns if c != "text"]
    return pages.select(*kept, F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def repeat_lines(pages: DataFrame, top_n: int = 3, thresh: float = 0.6) -> DataFrame:
    """``doc_name, side, line`` of lines that are among the first (head) or last (foot) ``top_n``
    non-blank ones on at least ``thresh`` of a document's pages, repeats on a page included."""
    n_pages = pages.groupBy("doc_name").agg(F.count("*").alias("n_pages"))
    return count_ends(with_ends(pages, top_n)).join(n_pages, "doc_name").where(F.col("n") / F.col("n_pages") >= thresh)


def with_ends(pages: DataFrame, top_n: int = 3) -> DataFrame:
    """Add ``ends``: a page's first (head) and last (foot) non-blank lines."""
    found = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    head = F.slice("__l", 1, top_n)
    foot = F.slice("__l", F.greatest(F.lit(1), F.size("__l") - top_n + 1), top_n)
    named = lambda side, lines: F.transform(lines, lambda x: F.struct(F.lit(side).alias("side"), x.alias("line")))
    return pages.withColumn("__l", found).withColumn("ends", F.concat(named("head", head), named("foot", foot))).drop("__l")


def count_ends(pages: DataFrame) -> DataFrame:
    """``doc_name, side, line, n``: on how many of a document's pages (doc_name, ends) a line is
    among the first or last, repeats on a page included."""
    return pages.select("doc_name", F.inline("ends")).groupBy("doc_name", "side", "line").agg(F.count("*").alias("n"))


def drop_repeat_lines(lines: DataFrame, repeats: DataFrame) -> DataFrame:
    """Lines of which the document has no repeated head or foot line of exactly that text."""
    return lines.join(repeats.select("doc_name", "line").distinct(), ["doc_name", "line"], "left_anti")


def reading_order(blocks: DataFrame, gap: float = 80.0) -> DataFrame:
    """Add ``rank``: left column before right, each by (y0, x0). A page has two columns if the
    largest gap between neighbouring x0 exceeds ``gap``; the first such gap is split midway."""
    page = Window.partitionBy("doc_name", "page")
    steps = blocks.withColumn("before", F.lag("x0").over(page.orderBy("x0", "pos")))
    steps = steps.where("before is not null").withColumn("d", F.col("x0") - F.col("before"))
    widest = steps.groupBy("doc_name", "page").agg(F.max_by(F.struct("d", "before", "x0"), F.struct("d", -F.col("x0"))).alias("w"))
    split = widest.select("doc_name", "page", F.when(F.col("w.d") > gap, (F.col("w.before") + F.col("w.x0")) / 2).alias("split"))
    placed = blocks.join(split, ["doc_name", "page"], "left").withColumn("column", F.coalesce((F.col("x0") >= F.col("split")).cast("int"), F.lit(0)))
    return placed.withColumn("rank", F.row_number().over(page.orderBy("column", F.round("y0", 1), F.round("x0", 1), "pos"))).drop("split")


def mathiness(blocks: DataFrame) -> DataFrame:
    """Add 0.6 for a mathematical font and up to 0.4 for the density of symbols."""
    font = F.lower(F.col("font")).rlike("(cmr|cmmi|cmsy|cmex|stix|cambria|symbol|math)").cast("int")
    dens = F.regexp_count("text", F.lit(T.OPERATORS)) / F.greatest(F.lit(1), F.length("text"))
    return blocks.withColumn("mathiness", 0.6 * font + 0.4 * F.least(F.lit(1.0), 8 * dens))


def math_pages(blocks: DataFrame, least: float = 0.6, longest: int = 220) -> DataFrame:
    """``doc_name, page`` of pages with a short block that is mathematical enough."""
    found = mathiness(blocks).where((F.col("mathiness") >= least) & (F.length("text") <= longest))
    return found.select("doc_name", "page").distinct()


def segment_lines(lines: DataFrame) -> DataFrame:
    """Headings, bullets and paragraphs in page order; plain lines that follow each other join."""
    line = F.col("line")
    kind = F.when(line.rlike(T.HEADING), "heading").when(line.rlike(T.BULLET), "bullet").when(F.trim(line) == "", "blank").otherwise("para")
    page = Window.partitionBy("doc_name", "page").orderBy("pos")
    starts = (F.col("kind") != "para") | (F.lag("kind", 1, "blank").over(page) != "para")
    marked = lines.withColumn("kind", kind).withColumn("starts", starts.cast("int")).withColumn("segment", F.sum("starts").over(page))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.trim("line").alias("t")))), lambda x: x["t"]), " ")
    return marked.where("kind <> 'blank'").groupBy("doc_name", "page", "segment", "kind").agg(joined.alias("text"), F.min("pos").alias("pos"))


def heading_path(segments: DataFrame) -> DataFrame:
    """Add the last heading before or at each segment of its page, empty if there is none."""
    page = Window.partitionBy("doc_name", "page").orderBy("pos")
    last = F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(page)
    return segments.withColumn("heading_path", F.coalesce(last, F.lit("")))


def section_tag(df: DataFrame) -> DataFrame:
    """Add "exercises" where the heading speaks of exercises, problems, answers or reviews."""
    return df.withColumn("section_tag", F.when(F.coalesce("heading_path", F.lit("")).rlike(T.EXERCISE_HEADING), "exercises").otherwise(""))


def split_sentences(df: DataFrame, variant: str = "a", col: str = "text") -> DataFrame:
    """One row a sentence, numbered from 0."""
    kept = [c for c in df.columns if c != col]
    return df.select(*kept, F.posexplode(T.sentences(col, variant)).alias("pos", "sentence"))


def dehyphenate(lines: DataFrame, key: list[str], order: str = "pos") -> DataFrame:
    """Join a line that ends in a hyphen with a following lower-case start: the pair's text
    stands at the first line, all other lines as they are."""
    w = Window.partitionBy(*key).orderBy(order)
    following, before = F.lead("line").over(w), F.lag("line").over(w)
    glues = F.col("line").endswith("-") & F.coalesce(following, F.lit("")).rlike("^[a-zß-öø-ÿ]")
    taken = F.coalesce(before, F.lit("")).endswith("-") & F.col("line").rlike("^[a-zß-öø-ÿ]")
    glued = F.concat(F.regexp_replace("line", "-$", ""), following)
    return lines.withColumns({"joined": F.when(glues, glued).otherwise(F.col("line")), "taken": taken, "glues": glues}).where(
        "not taken or glues"
    ).drop("taken", "glues")


def doc_budget(pages: DataFrame, normalized: bool = False) -> DataFrame:
    """Tokens a chunk aims at and repeats: fewer for documents of one or two short pages."""
    size = F.sum(F.length(F.col("text") if normalized else T.normalize_text(F.coalesce("text", F.lit("")))))
    return with_budget(pages.groupBy("doc_name").agg(F.count("*").alias("n_pages"), F.coalesce(size, F.lit(0)).alias("n_chars")))


def with_budget(d: DataFrame) -> DataFrame:
    """Add ``target`` and ``overlap`` to documents' ``n_pages`` and ``n_chars``."""
    small = (F.col("n_pages") <= 2) & (F.col("n_chars") < 6000)
    return d.withColumns({"target": F.when(small, 520).otherwise(750), "overlap": F.when(small, 70).otherwise(90)})


def pack(df: DataFrame, key: list[str], order: str, size: str, budget: int, stretch: float | None = None) -> DataFrame:
    """Add ``batch``, from 0: a row opens a new batch where the batch's size would pass
    ``budget``; with ``stretch``, a batch that reaches stretch * budget also closes.

    A key's rows are folded one after the other as they stream by in order, key, order and size
    of each alone, so a key may have any number of rows."""
    slim = df.select(*key, order, F.col(size).cast("long").alias("__size"))
    shape = StructType([*slim.schema.fields[:-1], StructField("batch", IntegerType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, at = None, 0, 0
        for rows in batches:
            out = []
            for *name, n in zip(*(rows.column(c).to_pylist() for c in [*range(len(key)), len(key) + 1])):
                if name != now:
                    now, used, at = name, 0, 0
                if used > 0 and used + n > budget or stretch and used >= stretch * budget:
                    used, at = 0, at + 1
                used += n
                out.append(at)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(out, pa.int32())], names=shape.names)

    placed = slim.repartition(*key).sortWithinPartitions(*key, order).mapInArrow(fold, shape)
    return df.join(placed, [*key, order])


def chunk_flags(df: DataFrame) -> DataFrame:
    """Add has_math, has_table, n_ops, is_equation and char_start, char_end of pieces (doc_name,
    page, pos, text) along their page, one character between neighbours. An equation stands on
    a page of mathematics (``math_page``, where the column is given), has an operator and few words."""
    hint = F.coalesce("math_page", F.lit(False)) if "math_page" in df.columns else F.lit(False)
    page = Window.partitionBy("doc_name", "page").orderBy("pos")
    end = F.sum(F.length("text") + 1).over(page)
    return df.withColumns(
        {
            "has_math": F.col("text").rlike(T.MATH),
            "has_table": F.col("text").rlike(T.TABLE_HINT) | (F.contains("text", F.lit("|")) & (F.length("text") > 10)),
            "n_ops": F.regexp_count("text", F.lit(T.OPERATORS)),
            "is_equation": hint & (F.regexp_count("text", F.lit(T.OPERATORS)) >= 1) & (F.regexp_count("text", F.lit("[A-Za-z]{3,}")) <= 40),
            "char_end": end,
            "char_start": end - F.length("text") - 1,
        }
    )


CHUNKS = (
    "doc_name string, page_start int, page_end int, n int, text string, heading_path string, section_tag string, "
    "has_math boolean, has_table boolean, is_equation boolean, char_start int, char_end int"
)
_HEADING, _BULLET, _MATH, _OPS = (re.compile(x) for x in (T.HEADING, T.BULLET, T.MATH, T.OPERATORS))
_TABLE, _EXERCISES = re.compile(T.TABLE_HINT), re.compile(T.EXERCISE_HEADING)
_END, _BLANKS, _WORD = re.compile(r"(?<=[.!?;:])\s+(?=[A-Z0-9(])"), re.compile(r"\s+"), re.compile("[A-Za-z]{3,}")


class _Packer:
    """Fills chunks of one page up to a token target, repeating the end of each in the next."""

    def __init__(self, target: int, overlap: int, math_page: bool):
        self.target, self.overlap, self.math_page = target, overlap, math_page
        self.done: list[dict] = []
        self.heading, self.cursor = "", 0
        self.clear()

    def clear(self, tail: str = "") -> None:
        self.parts = [tail] if tail else []
        self.size = tokens(tail) if tail else 0
        self.start = max(0, self.cursor - len(tail))
        self.flags = {"has_math": False, "has_table": False, "is_equation": False}

    def flush(self, carry: bool) -> None:
        text = " ".join(self.parts).strip()
        if text:
            tag = "exercises" if _EXERCISES.search(self.heading.lower()) else ""
            self.done.append({"text": text, "heading_path": self.heading, "section_tag": tag, "char_start": self.start, "char_end": self.cursor, **self.flags})
        self.clear(" ".join(self.parts)[-4 * self.overlap :] if carry else "")

    def add(self, piece: str) -> None:
        if not self.parts:
            self.start = self.cursor
        self.parts.append(piece)
        self.size += tokens(piece)
        flags = self.flags  # what is set stays set, and is not looked for again
        flags["has_math"] = flags["has_math"] or bool(_MATH.search(piece))
        flags["has_table"] = flags["has_table"] or bool(_TABLE.search(piece)) or ("|" in piece and len(piece) > 10)
        if self.math_page and not flags["is_equation"] and _OPS.search(piece):
            flags["is_equation"] = len(_WORD.findall(piece)) <= 40

    def sentence(self, piece: str) -> None:
        whole = piece
        if self.parts and self.parts[-1].endswith("-") and piece:
            last = self.parts.pop()
            whole = last[:-1] + piece if piece[0].islower() else f"{last} {piece}"
            self.size = tokens(" ".join(self.parts))
        if self.parts and self.size + tokens(whole) > self.target:
            self.flush(carry=True)
        self.add(whole)
        self.cursor += len(piece) + 1


def tokens(text: str) -> int:
    return max(1, len(text) // 4)


def chunk_page(text: str, target: int, overlap: int, dropped: set[str], math_page: bool = False) -> list[dict]:
    """Chunks of one page. Headings end a chunk and stand over what follows; a bullet starts a
    new chunk once four fifths are full; sentences fill up to the target."""
    p = _Packer(target, overlap, math_page)
    plain: list[str] = []

    def paragraph() -> None:
        whole = " ".join(plain).strip()
        plain.clear()
        for s in [x.strip() for x in _END.split(_BLANKS.sub(" ", whole))] if len(whole) > 20 else [whole]:
            if s:
                p.sentence(s)

    for line in text.split("\n"):
        if line in dropped:
            continue
        kind = "heading" if _HEADING.match(line) else "bullet" if _BULLET.match(line) else "plain" if line.strip() else "blank"
        if kind == "plain":
            plain.append(line.strip())
            continue
        paragraph()
        if kind == "heading":
            p.flush(carry=False)
            p.heading = line.strip()
            p.cursor += len(p.heading) + 1
        elif kind == "bullet":
            if p.parts and p.size > 0.8 * target:
                p.flush(carry=True)
            p.add(line.strip())
            p.cursor += len(line.strip()) + 1
    paragraph()
    p.flush(carry=False)
    return p.done


def chunk_pages(pages: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Chunks (:data:`CHUNKS`, numbered from 1 on each page) of all pages. A page is a row, with
    its document's budget and repeated lines beside it, so pages are chunked independently.
    ``blocks`` (doc_name, page, text, font) tell which pages hold mathematics; without them no
    chunk is an equation."""
    clean = pages.withColumn("text", T.normalize_text(F.coalesce("text", F.lit(""))))
    repeats = repeat_lines(clean).groupBy("doc_name").agg(F.collect_set("line").alias("dropped"))
    rows = clean.join(doc_budget(clean, normalized=True), "doc_name").join(repeats, "doc_name", "left")
    rows = rows.withColumn("math_page", F.lit(False)) if blocks is None else rows.join(math_pages(blocks).withColumn("math_page", F.lit(True)), ["doc_name", "page"], "left")
    return chunk_rows(rows.withColumn("math_page", F.coalesce("math_page", F.lit(False))))


def chunk_rows(rows: DataFrame, blank: bool = False) -> DataFrame:
    """Chunks of rows ``doc_name, page, text, target, overlap, dropped, math_page``. With ``blank`` a
    page without chunks is a row whose ``n`` is 0 and whose text is null."""
    rows = rows.select("doc_name", "page", "text", "target", "overlap", "dropped", "math_page")

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, numbers, *rest = (c.to_pylist() for c in batch.columns)
            found = [chunk_page(text, target, overlap, set(dropped or ()), math) for text, target, overlap, dropped, math in zip(*rest)]
            begin = [1 if x else 0 for x in found]
            found = [x or ([{}] if blank else []) for x in found]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            columns = {"doc_name": batch.column(0).take(pa.array(row)), "page_start": batch.column(1).take(pa.array(row))}
            columns["page_end"] = columns["page_start"]
            columns["n"] = pa.array([n for k, x in zip(begin, found) for n in range(k, len(x) + k)], pa.int32())
            for f in shape.names[4:]:
                columns[f] = pa.array([c.get(f) for x in found for c in x])
            yield pa.RecordBatch.from_arrays([columns[f].cast(kind) for f, kind in zip(shape.names, shape.types)], schema=shape)

    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    shape = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in CHUNKS.split(", "))])
    return rows.mapInArrow(chunk, CHUNKS)

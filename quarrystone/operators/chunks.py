"""Documents to chunks: normalized lines, blocks of HTML, section paths, and packing under a token limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import page_number, strip

TARGET, MOST = 400, 500
#: Code points of chunks that a task holds before it hands them on.
HELD = 1_000_000
SEPARATORS = ("\n\n", "\n", "。", "；", "，", "")


def normalized_lines(c: Column) -> Column:
    """Line ends made alike, spaces squeezed, page numbers dropped; a line goes on unless a sentence ends or a number starts."""
    t = F.regexp_replace(F.regexp_replace(F.translate(c, " ", " "), "\r\n?", "\n"), "[ \\t]+", " ")
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: (x != "") & ~page_number(x))

    def joined(text: Column, line: Column) -> Column:
        ends = text.rlike(r"[。！？!?；;：:]$") | line.rlike(r"^(?:\d+[.、．]|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）)")
        return F.when(text == "", line).when(ends, F.concat(text, F.lit("\n"), line)).otherwise(F.concat(text, F.when(text.rlike(r"[\x21-\x7E]$") & line.rlike(r"^[\x21-\x7E]"), " ").otherwise(""), line))

    return F.aggregate(lines, F.lit(""), joined)


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, position, kind, level, text: headings, paragraphs and list items in reading order; scripts, styles and navigation left out."""
    body = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style|nav|head)\b.*?</\1\s*>", " ")
    block = r"(?is)<(h[1-6]|p|li|td)\b[^>]*>(.*?)(?=<(?:h[1-6]|p|li|td|/article|/body|/html|footer)\b|$)"
    kinds, texts = (F.regexp_extract_all(body, F.lit(block), F.lit(i)) for i in (1, 2))
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(kinds.alias("k"), texts.alias("t"))).alias("position", "x"))
    plain = strip(F.regexp_replace(F.regexp_replace(F.col("x.t"), r"(?s)<[^>]*>", " "), r"(?U)\s+", " "))
    kind = F.lower(F.col("x.k"))
    named = F.when(kind.startswith("h"), "heading").when(kind == "li", "list").when(kind == "td", "table").otherwise("paragraph")
    level = F.when(kind.startswith("h"), F.substring(kind, 2, 1).cast("int"))
    return rows.select("page_id", "position", named.alias("kind"), level.alias("level"), plain.alias("text")).where("text <> ''")


def section_paths(blocks: DataFrame, key: str = "page_id", levels: int = 3) -> DataFrame:
    """Adds path, the headings above each block: the last heading of each level since the last one of a lower level."""
    w = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    df = blocks
    for n in range(1, levels + 1):
        resets = F.max(F.when(F.col("level") < n, F.col("position"))).over(w) if n > 1 else F.lit(None).cast("int")
        df = df.withColumn(f"_r{n}", resets)
        last = F.last(F.when(F.col("level") == n, F.struct("position", "text")), ignorenulls=True).over(w)
        df = df.withColumn(f"_h{n}", last)
        df = df.withColumn(f"_h{n}", F.when(F.col(f"_h{n}.position") > F.coalesce(f"_r{n}", F.lit(-1)), F.col(f"_h{n}.text")))
    path = F.array_compact(F.array(*[F.col(f"_h{n}") for n in range(1, levels + 1)]))
    return df.withColumn("path", path).drop(*[f"_{x}{n}" for n in range(1, levels + 1) for x in "rh"])


def padded(c: Column, width: int) -> Column:
    """Numbers as text with zeros before them, never cut."""
    t = c.cast("string")
    return F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)


def block_ids(blocks: DataFrame, key: str, prefix: Column) -> DataFrame:
    """Adds block_id: prefix_B0001 and so on in reading order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("position"))
    return blocks.withColumn("block_id", F.concat(prefix, F.lit("_B"), padded(n, 4)))


def pieces(text: str, count: Callable[[str], int], target: int = TARGET, most: int = MOST) -> list[str]:
    """Parts of a text, each of at most `most` tokens, packed greedily up to `target`; cut at the strongest separator that helps."""

    def fitting(t: str) -> int:
        """Code points of the longest beginning of a text that has no more than `most` tokens, one at least."""
        high = most
        while high < len(t) and count(t[:high]) <= most:
            high *= 2
        low, high = 1, min(high, len(t))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if count(t[:middle]) <= most else (low, middle - 1)
        return low

    def cut(t: str, level: int) -> list[str]:
        if count(t) <= most:
            return [t]
        sep = SEPARATORS[level]
        if not sep:
            out, at = [], 0
            while at < len(t):
                n = fitting(t[at:] if at else t)
                out.append(t[at : at + n])
                at += n
            return out
        parts = t.split(sep)
        parts = [p + sep for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
        return [x for p in parts for x in cut(p, level + 1)]

    out, now, size = [], "", 0
    for part in cut(text, 0):
        n = count(part)
        if now and size + n > target:
            out.append(now)
            now, size = "", 0
        now, size = now + part, size + n
    return [*out, now] if now else out


def chunked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", target: int = TARGET, most: int = MOST) -> DataFrame:
    """id, chunk_id, position, content, tokens: whole texts in order; a code point counts as a token, as in a test without a tokenizer."""
    kind = docs.schema[id_column].dataType.simpleString()

    def sent(held: list[tuple], first: pa.DataType) -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(columns, [first, pa.int32(), pa.string(), pa.int32()], strict=True)], [id_column, "position", "content", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                t = batch.column(1)[i].as_py()
                for n, c in enumerate(pieces(t, len, target, most) if t else (), 1):
                    held.append((batch.column(0)[i].as_py(), n, c, len(c)))
                    size += len(c)
                    if size >= HELD:
                        yield sent(held, batch.schema.field(0).type)
                        held, size = [], 0
            if held:
                yield sent(held, batch.schema.field(0).type)

    found = docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, position int, content string, tokens int")
    name = F.concat(F.lit("D"), padded(F.col(id_column), 6), F.lit("_C"), padded(F.col("position"), 4))
    return found.select(id_column, name.alias("chunk_id"), "position", "content", "tokens")


#: Forms of headings.
PRIMARY, SECONDARY, CLAUSE = r"^[一二三四五六七八九十百]+、\S.*$", r"^（[一二三四五六七八九十百]+）\S.*$", r"^\d+[\.．、]\s*\S.*$"
NUMBER = r"^(?:[一二三四五六七八九十百]+、|（[一二三四五六七八九十百]+）)"
HEADING = 30


def heading(c: Column, parser_heading: Column, roots: Sequence[str] = ()) -> Column:
    """is_heading, level, heading, body of a block's text: root titles, numbered headings of two levels, clauses the parser calls headings.

    A long numbered line is a heading and a body if it has a short title, ends it, and goes on with a longer explanation.
    """
    t = strip(c)
    level = F.when(t.isin(*roots) if roots else F.lit(False), 1).when(t.rlike(PRIMARY), 1).when(t.rlike(SECONDARY), 2)
    title = F.regexp_extract(t, r"(?s)^([^：:。]*[：:。])", 1)
    body = strip(F.substring(t, F.length(title) + 1, F.length(t)))
    short = F.length(strip(F.regexp_replace(F.when(title == "", t).otherwise(title), NUMBER, ""))) <= HEADING
    whole = (title == "") | (body == "")
    split = ~whole & short & (F.length(body) >= 24)
    numbered = t.rlike(PRIMARY) | t.rlike(SECONDARY)
    clause = t.rlike(CLAUSE)
    is_root = t.isin(*roots) if roots else F.lit(False)
    yes = F.when(is_root, True).when(numbered, short & (whole | split)).otherwise(parser_heading & (t != ""))
    rank = F.when(yes & level.isNotNull(), level).when(yes & clause, 3)
    return F.struct(F.coalesce(yes, F.lit(False)).alias("is_heading"), rank.cast("int").alias("level"), F.when(numbered & split, strip(title)).when(yes, t).alias("heading"), F.when(numbered & split, body).alias("body"))


def table_rows(rows: Column) -> Column:
    """Rows padded with blanks to the widest one, cells trimmed."""
    width = F.aggregate(rows, F.lit(0), lambda w, r: F.greatest(w, F.size(r)))
    return F.transform(rows, lambda r: F.concat(F.transform(r, lambda x: strip(F.coalesce(x, F.lit("")))), F.array_repeat(F.lit(""), width - F.size(r))))


def key_value_rows(rows: Column) -> Column:
    """Pairs of a table of two columns with a key; none of other tables."""
    pairs = F.filter(F.transform(rows, lambda r: F.struct(F.get(r, F.lit(0)).alias("key"), F.get(r, F.lit(1)).alias("value"))), lambda p: p.key != "")
    return F.when(F.forall(rows, lambda r: F.size(r) == 2), pairs).otherwise(F.filter(pairs, lambda p: F.lit(False)))


def sibling_runs(blocks: DataFrame, key: str = "page_id", least: int = 3, gap: int = 2) -> DataFrame:
    """key, run, first, last, size: runs of blocks numbered one after another, with at most `gap` other blocks between neighbours."""
    number = F.regexp_extract("text", r"^(\d{1,3})[.．、]", 1).try_cast("int")
    rows = blocks.select(key, "position", number.alias("number")).where("number is not null")
    w = Window.partitionBy(key).orderBy("position")
    new = (F.col("number") != F.lag("number").over(w) + 1) | (F.col("position") - F.lag("position").over(w) > gap + 1)
    rows = rows.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
    return rows.groupBy(key, "run").agg(F.min("position").alias("first"), F.max("position").alias("last"), F.count("*").alias("size")).where(F.col("size") >= least)


#: Forms of numbered lines that belong together, ends of a clause that is body text, and beginnings of a long one.
BRACKETED, DECIMAL = r"(?d)^（(\d+)）(?U:\s*)(.*)$", r"(?d)^(\d+)[.．](?U:\s*)(.*)$"
CLAUSE_ENDS, CLAUSE_BEGINS = r"[。！？；]$", r"^(?:甲方|乙方|本产品|本理财产品|投资者|客户|为|如|若|当|因)"
CLAUSE_LENGTH, SPREAD = 24, 36


def numbered_runs(blocks: DataFrame, form: str, gap: int, key: str = "page_id", parent: Column | None = None) -> DataFrame:
    """blocks with _number, _body and _run of the lines of that form; null for others.

    A run goes on with the next number, on the same or the next page, under the same parent, after at most `gap` paragraphs
    or list items. blocks: key, position, kind, level, text, path, page_start, page_end.
    """
    text = strip(F.col("text"))
    number = F.when(text.rlike(form), F.regexp_extract(text, form, 1).try_cast("int"))
    here = Window.partitionBy(key).orderBy("position")
    rows = blocks.withColumn("_number", number).withColumn("_body", F.when(number.isNotNull(), strip(F.regexp_extract(text, form, 2))))
    wall = F.col("_number").isNull() & ~F.col("kind").isin("paragraph", "list")
    rows = rows.withColumn("_at", F.row_number().over(here)).withColumn("_walls", F.count_if(wall).over(here)).withColumn("_parent", F.col("path") if parent is None else parent)
    own = Window.partitionBy(key, F.isnotnull("_number")).orderBy("position")
    before = {c: F.lag(c).over(own) for c in ("_number", "_at", "_walls", "_parent", "page_end")}
    on = (F.col("_number") == before["_number"] + 1) & (F.col("_at") - before["_at"] <= gap + 1) & (F.col("_walls") == before["_walls"])
    on = on & (F.col("page_start") - before["page_end"] <= 1) & F.col("_parent").eqNullSafe(before["_parent"])
    run = F.sum((~F.coalesce(on, F.lit(False))).cast("int")).over(own)
    return rows.withColumn("_run", F.when(F.col("_number").isNotNull(), run)).drop("_at", "_walls", "_parent")


def _steadied(rows: DataFrame, key: str, odd: Column, steady: Column, kind: Column, which: Column) -> DataFrame:
    """Headings `odd` of runs that are `steady` and for which `which` holds become body text of that kind; adds steadied."""
    rows = rows.withColumn("_yes", F.coalesce(F.col("_run").isNotNull() & steady & odd & which, F.lit(False))).withColumn("_kind", kind)
    rows = rows.withColumn("kind", F.when(F.col("_yes"), F.col("_kind")).otherwise(F.col("kind")))
    return rows.withColumn("level", F.when(~F.col("_yes"), F.col("level"))).withColumn("steadied", F.col("_yes")).drop("_number", "_body", "_run", "_yes", "_kind")


def steady_siblings(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Bracketed numbers of at least three in a row: single headings without a level among them become what their siblings are.

    Left alone where headings are the majority, or bodies differ much in length and none is a sentence.
    """
    last = F.try_element_at(F.col("path"), F.lit(-1))
    parent = F.when((F.col("kind") == "heading") & (F.size("path") > 0) & last.eqNullSafe(F.col("text")), F.slice("path", 1, F.size("path") - 1)).otherwise(F.col("path"))
    rows = numbered_runs(blocks, BRACKETED, 2, key, parent)
    w = Window.partitionBy(key, "_run")
    odd, plain = (F.col("kind") == "heading") & F.col("level").isNull(), F.col("kind").isin("paragraph", "list")
    told = F.count_if(plain & strip(F.col("text")).rlike(r"[。！？]$")).over(w) > 0
    spread = F.max(F.length("_body")).over(w) - F.min(F.length("_body")).over(w)
    steady = (F.count("*").over(w) >= 3) & (F.count_if(plain).over(w) >= F.count_if(odd).over(w)) & ((spread <= SPREAD) | told)
    kind = F.when(F.count_if(F.col("kind") == "list").over(w) > 0, "list").otherwise("paragraph")
    return _steadied(rows, key, odd, steady, kind, F.lit(True))


def steady_clauses(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Decimal clauses of at least three in a row, of which at least half (and two) are body sentences: such sentences that the
    parser made headings of level 3 become what most of the others are."""
    nested = F.coalesce(strip(F.try_element_at(F.col("path"), F.lit(-1))).rlike(DECIMAL), F.lit(False))
    rows = numbered_runs(blocks, DECIMAL, 1, key, F.when((F.size("path") > 0) & nested, F.slice("path", 1, F.size("path") - 1)).otherwise(F.col("path")))
    w = Window.partitionBy(key, "_run")
    odd, plain = (F.col("kind") == "heading") & (F.col("level") == 3), F.col("kind").isin("paragraph", "list")
    sentence = F.col("_body").rlike(CLAUSE_ENDS) | ((F.length("_body") >= CLAUSE_LENGTH) & F.col("_body").rlike(CLAUSE_BEGINS))
    size, plains = F.count("*").over(w), F.count_if(plain).over(w)
    steady = (size >= 3) & (plains >= 2) & (F.count_if(sentence).over(w) >= F.greatest(F.lit(2), F.floor((size + 1) / 2)))
    kind = F.when(F.count_if(F.col("kind") == "paragraph").over(w) * 2 >= plains, "paragraph").otherwise("list")
    return _steadied(rows, key, odd, steady, kind, sentence)


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def table_units(rows: Column, pairs: Column) -> Column:
    """What a table says, as lines: its key：value pairs at the row that holds both, then cells that no pair covers; rows of
    digits alone are left out. Without pairs each row is a line. rows: array of arrays; pairs: array of (key, value)."""
    cells = F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.transform(r, lambda x: strip(F.coalesce(x, F.lit("")))))
    known = F.transform(cells, lambda r: F.transform(r, squeezed))
    trimmed = F.transform(pairs, lambda p: F.struct(strip(F.coalesce(p.key, F.lit(""))).alias("key"), strip(F.coalesce(p.value, F.lit(""))).alias("value")))
    fine = F.filter(trimmed, lambda p: (p.key != "") | (p.value != ""))

    def place(p: Column) -> Column:
        key, value = squeezed(p.key), squeezed(p.value)
        return F.array_position(F.transform(known, lambda r: ((key == "") | F.array_contains(r, key)) & ((value == "") | F.array_contains(r, value))), F.lit(True))

    placed = F.transform(fine, lambda p: F.struct(F.concat(p.key, F.lit("："), p.value).alias("line"), place(p).alias("row")))
    covered = F.transform(placed, lambda p: squeezed(p.line))

    def lines(at: Column) -> Column:
        return F.transform(F.filter(placed, lambda p: p.row == at), lambda p: p.line)

    def alone(row: Column) -> Column:
        full = F.filter(row, lambda x: x != "")
        rest = F.filter(full, lambda x: ~F.exists(covered, lambda c: c.contains(squeezed(x))))
        return F.when(F.exists(full, lambda x: ~x.rlike(r"(?U)^\d+$")), rest).otherwise(F.array().cast("array<string>"))

    with_pairs = F.concat(F.flatten(F.transform(cells, lambda r, i: F.concat(lines(i + 1), alone(r)))), lines(F.lit(0)))
    whole = F.transform(F.filter(cells, lambda r: F.exists(r, lambda x: x != "")), lambda r: F.array_join(r, " | "))
    return F.when(F.size(fine) > 0, with_pairs).otherwise(whole)


def table_chunks(tables: DataFrame, id_column: str, target: int = TARGET, most: int = MOST) -> DataFrame:
    """id, position, content, tokens, split of tables (id, rows, pairs, text): units packed in order, one to a line.

    A chunk ends when the next unit would make it longer than `most`, or when it has `target` tokens already. A unit that is
    itself too long is split, and its chunks say so. A table without units is its text.
    """
    kind = tables.schema[id_column].dataType.simpleString()
    units = table_units(F.col("rows"), F.col("pairs"))
    plain = F.when(strip(F.col("text")) != "", F.array(strip(F.col("text")))).otherwise(F.array().cast("array<string>"))
    rows = tables.select(id_column, F.when(F.size(units) > 0, units).otherwise(plain).alias("units"))

    def packed(lines: Sequence[str]) -> Iterator[tuple[str, bool]]:
        now: list[str] = []
        size = 0
        for line in lines:
            if now and (size + 1 + len(line) > most or size >= target or len(line) > most):
                yield "\n".join(now), False
                now, size = [], 0
            if len(line) > most:
                yield from ((x, True) for x in pieces(line, len, target, most))
            else:
                size += len(line) + bool(now)
                now.append(line)
        if now:
            yield "\n".join(now), False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, n, c, len(c), s) for i, u in zip(b[id_column], b["units"], strict=True) if u is not None for n, (c, s) in enumerate(packed(list(u)), 1)]
            yield pd.DataFrame(out, columns=[id_column, "position", "content", "tokens", "split"])

    return rows.mapInPandas(run, f"`{id_column}` {kind}, position int, content string, tokens int, split boolean")


#: The least text of a page that needs no OCR, contents that a product document should have, and its codes.
PAGE_TEXT = 20
IMPORTANT = ("产品概述", "投资运作", "相关费用", "风险揭示", "风险评级", "销售对象")
CODE_NAMES = {"product_code": "产品代码", "sales_code": "销售代码"}


def page_fallback(pages: DataFrame, blocks: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Blocks (key, kind, text, page_start, page_end) with a paragraph for each page (key, page, text) that has text but no block
    with any; and issues (key, page, reason, severity): pages with next to no text, and pages that had to be filled in."""
    pages = pages.withColumn("_enough", F.length(strip(F.coalesce("text", F.lit("")))) >= PAGE_TEXT)
    held = blocks.where(strip(F.col("text")) != "").select(key, F.explode(F.sequence("page_start", "page_end")).alias("page")).distinct()
    filled = pages.where("_enough").join(held, [key, "page"], "left_anti")
    extra = filled.select(key, F.lit("paragraph").alias("kind"), "text", F.col("page").alias("page_start"), F.col("page").alias("page_end"))
    poor = pages.where("not _enough").select(key, "page", F.lit("OCR_REQUIRED").alias("reason"), F.lit("WARNING").alias("severity"))
    issues = poor.unionByName(filled.select(key, "page", F.lit("FALLBACK_PARSER_USED").alias("reason"), F.lit("INFO").alias("severity")))
    return blocks.select(key, "kind", "text", "page_start", "page_end").unionByName(extra), issues


def document_issues(documents: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, reason, detail, severity of documents (key, product_code, sales_code, page_count) and their blocks (key, text):
    no id or code, no pages, no blocks, important contents that no block names, and codes in the text that differ from the name's."""
    codes = {f: F.regexp_extract_all("text", F.lit(rf"(?U){n}\s*[：:]?\s*([A-Za-z0-9]{{6,16}})"), F.lit(1)) for f, n in CODE_NAMES.items()}
    seen = [F.coalesce(F.max(F.col("text").contains(w)), F.lit(False)).alias(f"_w{i}") for i, w in enumerate(IMPORTANT)]
    by = blocks.groupBy(key).agg(F.count("*").alias("_n"), *seen, *[F.array_distinct(F.flatten(F.collect_list(c))).alias(f"_{f}") for f, c in codes.items()])
    d = documents.join(by, key, "left")

    def problem(when: Column, reason: str, detail: str, severity: str) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(reason).alias("reason"), F.lit(detail).alias("detail"), F.lit(severity).alias("severity")))

    blank = {c: F.coalesce(strip(F.col(c).cast("string")), F.lit("")) == "" for c in (key, "product_code")}
    rows = [problem(blank[key], "MISSING_DOCUMENT_ID", "", "ERROR"), problem(blank["product_code"], "MISSING_PRODUCT_CODE", "", "ERROR")]
    rows += [problem(F.coalesce("page_count", F.lit(0)) <= 0, "INVALID_PAGE_COUNT", "", "ERROR"), problem(F.col("_n").isNull(), "EMPTY_BLOCKS", "", "ERROR")]
    rows += [problem(~F.coalesce(F.col(f"_w{i}"), F.lit(False)), "IMPORTANT_CONTENT_NOT_FOUND", w, "WARNING") for i, w in enumerate(IMPORTANT)]
    rows += [problem((F.size(f"_{f}") > 0) & ~F.array_contains(f"_{f}", F.coalesce(F.col(f), F.lit(""))), "FILENAME_METADATA_MISMATCH", f, "WARNING") for f in CODE_NAMES]
    return d.select(key, F.explode(F.array_compact(F.array(*rows))).alias("x")).select(key, "x.*")


def document_status(documents: DataFrame, issues: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, status: FAILED with an error, SUCCESS_WITH_WARNINGS with a warning, else SUCCESS."""
    worst = issues.groupBy(key).agg(F.max(F.col("severity") == "ERROR").alias("_e"), F.max(F.col("severity") == "WARNING").alias("_w"))
    status = F.when(F.col("_e"), "FAILED").when(F.col("_w"), "SUCCESS_WITH_WARNINGS").otherwise("SUCCESS")
    return documents.select(key).join(worst, key, "left").select(key, status.alias("status"))


def embedding_batches(chunks: DataFrame, key: str, size: int = 10) -> DataFrame:
    """Chunks (key, position, chunk_id, embedding_text) with batch and index: so many to a request, in order, within a document."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("position", "chunk_id")) - 1
    return chunks.withColumn("batch", F.floor(n / size).cast("int")).withColumn("index", (n % size).cast("int"))


def embedded(batches: DataFrame, answers: DataFrame, key: str, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """chunk_id and vector of the batches that were answered whole, and (key, batch, problem) of the others.

    answers: key, batch, index, vector. A batch stands or falls whole: repeated chunks, empty texts, another number of answers,
    indexes that are repeated or not asked for, vectors of another length or with values that aren't finite.
    """
    asked = batches.groupBy(key, "batch").agg(F.count("*").alias("_n"), F.count_distinct("chunk_id").alias("_ids"), F.count_if(F.coalesce(strip(F.col("embedding_text")), F.lit("")) == "").alias("_blank"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.coalesce((F.size("vector") == dimensions) & finite, F.lit(False))
    got = answers.groupBy(key, "batch").agg(F.count("*").alias("_got"), F.count_distinct("index").alias("_indexes"), F.min("index").alias("_least"), F.max("index").alias("_most"), F.count_if(~fits).alias("_bad"))
    n = F.col("_n")
    problem = F.when(F.col("_ids") < n, "DUPLICATE_CHUNK").when(F.col("_blank") > 0, "EMPTY_TEXT").when(F.coalesce("_got", F.lit(0)) != n, "ANSWER_COUNT")
    problem = problem.when((F.col("_indexes") != n) | (F.col("_least") != 0) | (F.col("_most") != n - 1), "ANSWER_INDEX").when(F.col("_bad") > 0, "INVALID_VECTOR")
    verdict = asked.join(got, [key, "batch"], "left").select(key, "batch", problem.alias("problem"))
    whole = batches.join(verdict.where("problem is null").select(key, "batch"), [key, "batch"], "left_semi")
    return whole.join(answers, [key, "batch", "index"]).select("chunk_id", "vector"), verdict.where("problem is not null")


def markdown(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """key and the document as Markdown: headings by level, list items, paragraphs, in order of position."""
    line = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(6))), F.lit(" "), F.col("text"))).when(F.col("kind") == "list", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return blocks.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x.line), "\n\n").alias("markdown"))


def violations(chunks: DataFrame, most: int = MOST) -> DataFrame:
    """chunk_id, problem of chunks that can't be indexed: blank or repeated id, empty or too long content."""
    again = F.count("*").over(Window.partitionBy("chunk_id")) > 1
    problem = F.when(F.coalesce(strip(F.col("chunk_id")), F.lit("")) == "", "BLANK_ID").when(again, "DUPLICATE_ID").when(F.coalesce(strip(F.col("content")), F.lit("")) == "", "EMPTY").when(F.col("tokens") > most, "TOO_LONG")
    return chunks.withColumn("problem", problem).where("problem is not null").select("chunk_id", "problem")


def schema_differences(found: DataFrame, expected: dict[str, str]) -> list[str]:
    """What stands against writing into an existing table: missing columns and other types. Nothing is recreated."""
    have = dict(found.dtypes)
    return [f"{c}: missing" if c not in have else f"{c}: {have[c]}, not {t}" for c, t in expected.items() if have.get(c) != t]


def embedding_text(product: Column, path: Column, content: Column) -> Column:
    """Labelled lines; a missing product or an empty path leaves its line out."""
    section = F.when(F.size(path) > 0, F.concat(F.lit("章节："), F.array_join(path, " > ")))
    return F.concat_ws("\n", F.when(product.isNotNull(), F.concat(F.lit("产品："), product)), section, F.concat(F.lit("内容："), content))

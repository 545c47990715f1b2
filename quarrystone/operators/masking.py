"""Masked customer payloads: aliases in place of names, evidence numbers, capped sections, checks before and after.

A payload is rows with a person key. Names become aliases that are stable within a person; texts lose direct identifiers and
known names; everything left out is recorded as an omission.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from quarrystone.functions import security
from quarrystone.functions.records import canonical_json
from quarrystone.functions.text import name_key, strip

#: Alias letters of entity types; the customer is always P-1.
LETTERS = {"Person": "P", "Enterprise": "E", "FamilyMember": "F", "Organization": "O", "Counterparty": "C", "Event": "V", "MarketSegment": "M", "Node": "N"}
SUFFIXES = r"(?:股份有限公司|有限责任公司|有限公司|控股|集团|公司)+$"
TOKEN = re.compile(r"(?<![A-Za-z0-9-])([PEFOCVMN])-(\d{1,4})(?![A-Za-z0-9-])")
GAP = "[\\s​-‏⁠﻿]*"


def aliases(entities: DataFrame, person: str = "person_id") -> DataFrame:
    """Adds alias: letter and number of each entity (person, entity_type, entity_id, is_customer) in the order of ids; the customer is P-1."""
    letters = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])
    keys = entities.select(person, "entity_type", "entity_id", "is_customer").distinct()
    w = Window.partitionBy(person, "entity_type").orderBy(F.desc("is_customer"), "entity_id")
    letter = F.coalesce(F.try_element_at(letters, F.col("entity_type")), F.lit("N"))
    return keys.withColumn("alias", F.concat(letter, F.lit("-"), F.row_number().over(w).cast("string")))


def name_bindings(named: DataFrame, person: str = "person_id") -> DataFrame:
    """person, name, alias: names and their short forms that stand for one alias only. named: person, name, alias."""
    bare = strip(F.regexp_replace("name", r"[（(][^（）()]*[）)]", ""))
    forms = F.array_distinct(F.filter(F.array(strip(F.col("name")), bare, F.regexp_replace(bare, SUFFIXES, "")), lambda n: F.length(n) >= 2))
    rows = named.select(person, "alias", F.explode(forms).alias("name"))
    w = Window.partitionBy(person, name_key(F.col("name")))
    return rows.withColumn("_n", F.size(F.collect_set("alias").over(w))).where("_n = 1").drop("_n").distinct()


def evidence_numbers(rows: DataFrame, person: str = "person_id", source: str = "source_id") -> DataFrame:
    """person, source, evidence: SRC-n for the person's sources in order."""
    w = Window.partitionBy(person).orderBy(source)
    return rows.where(F.col(source).isNotNull()).select(person, source).distinct().withColumn("evidence", F.concat(F.lit("SRC-"), F.row_number().over(w).cast("string")))


_GAPS = re.compile(GAP[:-1] + "+")
#: Parts that a person's rows are dealt to, so that no person's texts are one task; names go to each.
SALTS = 8


def _folded(c: str) -> str:
    """A letter without case; letters that become several stay."""
    up = c.upper()
    low = (up if len(up) == 1 else c).lower()
    return low if len(low) == 1 else c


def _word(c: str) -> bool:
    return c.isascii() and c.isalnum()


class Names:
    """All names of a person as one automaton (Aho-Corasick) over letters without case; gaps between letters are skipped.

    A text is gone through once, whatever the number of names. Longer names win, then names in order, each from left to right.
    """

    def __init__(self, known: list[tuple[str, str]]) -> None:
        import ahocorasick

        self.alias, self.rank, self.find = dict(known), {}, ahocorasick.Automaton()
        forms: dict[str, list[str]] = {}
        for rank, name in enumerate(sorted(self.alias, key=lambda n: (-len(n), n))):
            self.rank[name] = rank
            if form := "".join(map(_folded, _GAPS.sub("", name))):
                forms.setdefault(form, []).append(name)
        for form, names in forms.items():
            self.find.add_word(form, (len(form), names))
        if forms:
            self.find.make_automaton()
        self.exact = {n: re.compile(GAP.join(map(re.escape, n)), re.IGNORECASE) for n in self.alias if _GAPS.search(n)}

    def replaced(self, text: str | None) -> str | None:
        if not text or not len(self.find):
            return text
        places = [i for i, c in enumerate(text) if not _GAPS.match(c)]
        hits = []
        for end, (size, names) in self.find.iter("".join(_folded(text[i]) for i in places)):
            a, b = places[end - size + 1], places[end] + 1
            hits += [(self.rank[n], a, b, n) for n in names if n not in self.exact or self.exact[n].fullmatch(text, a, b)]
        taken, out = [], [*text]
        state = bytearray(len(text) + 2)  # 1: taken by a name, so that an alias stands there
        for _, a, b, name in sorted(hits):
            if any(state[a + 1 : b + 1]):
                continue
            if name.isascii() and name[:1].isalnum():
                left = state[a] or (a and _word(text[a - 1]))
                right = state[b + 1] or (b < len(text) and _word(text[b]))
                if left or right:
                    continue
            state[a + 1 : b + 1] = b"\1" * (b - a)
            taken.append((a, b, self.alias[name]))
        for a, b, alias in taken:
            out[a] = alias
            out[a + 1 : b] = [""] * (b - a - 1)
        return "".join(out)


def with_aliases(rows: DataFrame, bindings: DataFrame, column: str, person: str = "person_id") -> DataFrame:
    """Texts with the person's names replaced, longest first, whatever spaces or zero-width characters stand between their letters.

    Names and rows of a person come in one sorted stream, names first: a task builds a person's automaton once and holds one
    text at a time. Rows of a person are dealt to `SALTS` tasks.
    """
    columns = rows.columns
    own = rows.withColumn("_salt", F.when(F.col(person).isNull(), F.pmod(F.xxhash64(column), F.lit(1 << 20))).otherwise(F.pmod(F.xxhash64(column), F.lit(SALTS))).cast("int"))
    own = own.withColumn("_name", F.lit(None).cast("string")).withColumn("_alias", F.lit(None).cast("string"))
    names = bindings.where(F.col(person).isNotNull() & F.col("name").isNotNull()).select(person, F.col("name").alias("_name"), F.col("alias").alias("_alias"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    stream = own.unionByName(names, allowMissingColumns=True).repartition(F.col(person), F.col("_salt")).sortWithinPartitions(F.col(person), F.col("_salt"), F.col("_name").isNull(), F.col("_name"))
    at, key, text = len(columns), columns.index(person), columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, known, tool = None, [], None
        for batch in batches:
            people, salts, found, aliases_, texts = (batch.column(i).to_pylist() for i in (key, at, at + 1, at + 2, text))
            out, keep = [], []
            for i, person_ in enumerate(people):
                if (person_, salts[i]) != whose:
                    whose, known, tool = (person_, salts[i]), [], None
                if found[i] is not None:
                    known.append((found[i], aliases_[i]))
                    continue
                if tool is None and known:
                    tool = Names(known)
                keep.append(i)
                out.append(tool.replaced(texts[i]) if tool else texts[i])
            if keep:
                some = batch.take(pa.array(keep, pa.int64()))
                arrays = [pa.array(out, some.column(text).type) if i == text else some.column(i) for i in range(at)]
                yield pa.RecordBatch.from_arrays(arrays, columns)

    return stream.mapInArrow(run, rows.schema)


def masked_text(rows: DataFrame, bindings: DataFrame, column: str, most: int = 600, person: str = "person_id") -> DataFrame:
    """Names to aliases, identifiers redacted, cut to `most` code points; `truncated` tells."""
    out = with_aliases(rows, bindings, column, person).withColumn(column, security.redact_direct(F.col(column)))
    cut, over = security.truncated(F.col(column), most)
    return out.withColumn("truncated", over).withColumn(column, cut)


@F.pandas_udf(StringType())
def _restored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, names in batches:
        out = []
        for text, known in zip(texts, names, strict=True):
            table = {k["alias"]: k["name"] for k in known} if known is not None else {}
            out.append(text and TOKEN.sub(lambda m, t=table: t.get(m[0], m[0]), text))
        yield pd.Series(out, dtype=object)


def restored(rows: DataFrame, names: DataFrame, column: str, person: str = "person_id") -> DataFrame:
    """Aliases back to names (person, alias, name); unknown ones stay."""
    known = names.groupBy(person).agg(F.collect_list(F.struct("alias", "name")).alias("_names"))
    return rows.join(known, person, "left").withColumn(column, _restored(F.col(column), F.col("_names"))).drop("_names")


def prohibited(text: Column, terms: Column) -> Column:
    """Terms of an array that occur in a text: digits and ASCII words between boundaries, others anywhere once spaces are out.

    text is a column that security.normalized has made; a Python function can't stand within the search of an array.
    """
    low, compact = F.lower(text), F.lower(F.regexp_replace(text, GAP, ""))

    def hit(term: Column) -> Column:
        t = F.lower(term)
        plain = t.rlike(r"^[\x21-\x7E]+$")
        bounded = F.regexp_like(low, F.concat(F.lit(r"(?<![a-z0-9])\Q"), t, F.lit(r"\E(?![a-z0-9])")))
        return F.when(plain, bounded).otherwise(F.contains(compact, F.regexp_replace(t, GAP, "")))

    return F.filter(terms, hit)


def unsafe_fields(rows: DataFrame, keys: Sequence[str], texts: Sequence[str], most: int = 600) -> DataFrame:
    """keys, field, problem of text fields that must not be sent: blank, too long, or with an identifier left."""
    out = None
    for c in texts:
        t = F.col(c)
        problem = F.when(t.isNotNull() & (strip(t) == ""), "BLANK").when(F.length(t) > most, "TOO_LONG").otherwise(security.detected(t))
        part = rows.select(*keys, F.lit(c).alias("field"), problem.alias("problem")).where("problem is not null")
        out = part if out is None else out.unionByName(part)
    return out


def omissions(found: DataFrame, person: str = "person_id", most: int = 100) -> DataFrame:
    """The first omissions of each person (position, field, reason) in order, and how many there are."""
    own = Window.partitionBy(person)
    rows = found.withColumn("number", F.row_number().over(own.orderBy("position", "field", "reason"))).withColumn("total", F.count("*").over(own))
    return rows.where(F.col("number") <= most)


def sealed(payload: Column, most: int = 256 * 1024, kind: DataType | None = None) -> tuple[Column, Column, Column]:
    """JSON of a struct, its SHA-256, and whether its bytes fit; with the payload's type keys are in order at all depths."""
    body = F.to_json(payload) if kind is None else canonical_json(payload, kind)
    return body, F.sha2(body, 256), F.octet_length(body) <= most


def without_source(rows: DataFrame, keys: Sequence[str], content: Sequence[str], position: str) -> DataFrame:
    """First row of each content, whatever its source reference."""
    w = Window.partitionBy(*keys, F.to_json(F.struct(*content))).orderBy(position)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

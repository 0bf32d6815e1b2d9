"""One form for text that looks the same (problem 3).

The mapping runs as SQL of an embedded DuckDB inside each Arrow batch: a
regular expression drops characters without width, ``translate`` maps
compatibility forms, blanks and look-alikes, a lookup spells out ligatures and
``nfc_normalize`` composes accents.  Spark partitions and joins the rows.

What stays different: case, missing accents, raised and circled digits, line
breaks, the number of blanks, mark-up signs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import glyphs

#: Most memory DuckDB may take in one Python worker.
DUCKDB_MEMORY = "400MB"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _char_class(chars: str) -> str:
    """A regular-expression class of characters, as ranges."""
    points = sorted(map(ord, chars))
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


#: Stands for the text in the SQL of a step; private-use, so in no table of characters.
_TEXT = chr(0xE000)


def _steps() -> tuple[str, str]:
    """SQL of the two steps, _TEXT standing for the text: invisible and single characters,
    then ligatures and look-alikes."""
    single, alike, multi = glyphs.compat_single(), glyphs.lookalike_single(), glyphs.compat_multi()
    spelled = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in multi.items()) + "}"
    ligature = _quoted(_char_class("".join(multi)))
    forms = f"translate(regexp_replace({_TEXT}, {_quoted(_char_class(glyphs.invisible()))}, '', 'g'), {_quoted(''.join(single))}, {_quoted(''.join(single.values()))})"
    spell = f"CASE WHEN regexp_matches({_TEXT}, {ligature}) THEN array_to_string(list_transform(string_split({_TEXT}, ''), lambda c: coalesce({spelled}[c], c)), '') ELSE {_TEXT} END"
    return forms, f"nfc_normalize(translate(nfc_normalize({spell}), {_quoted(''.join(alike))}, {_quoted(''.join(alike.values()))}))"


@lru_cache(maxsize=1)
def macro_sql() -> str:
    """DuckDB macro visible(s): s in the one form."""
    forms, rest = _steps()
    return f"""
CREATE OR REPLACE MACRO lettered(s) AS {rest.replace(_TEXT, "s")};
CREATE OR REPLACE MACRO visible(s) AS lettered({forms.replace(_TEXT, "s")});
"""


def visible_sql(table: str, key: str, text: str) -> str:
    """One query for (key, text, text_visible) of a table, without macros."""
    forms, rest = _steps()
    first = f"SELECT {key}, {text} AS text, {forms.replace(_TEXT, text)} AS s FROM {table}"
    return f"SELECT {key}, text, {rest.replace(_TEXT, 's')} AS text_visible FROM ({first})"


def _connection():  # noqa: ANN202
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY})
    con.execute(macro_sql())
    return con


def _run_sql(df: DataFrame, sql: str, schema: T.StructType) -> DataFrame:
    """The SQL over each Arrow batch, which it knows as the table part."""
    macro_sql()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        for batch in batches:
            con.register("part", pa.Table.from_batches([batch]))
            yield from con.sql(sql).to_arrow_table().to_batches()
            con.unregister("part")

    return df.mapInArrow(run, schema)


def normalised(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, text_visible) of every row.

    Null text stays null and empty text empty; text of any length is mapped
    whole; repeated rows give repeated results; other columns are not read."""
    schema = T.StructType([df.schema[key], T.StructField("text", T.StringType()), T.StructField("text_visible", T.StringType())])
    part = df.select(F.col(key), F.col(text).alias("text"))
    return _run_sql(part, f'SELECT "{key}", text, visible(text) AS text_visible FROM part', schema)


def citations_of(bench: DataFrame, extra: Column) -> DataFrame:
    """Distinct (vid, chunk_id, extra column named quote)."""
    return bench.select("vid", extra.alias("quote"), F.explode("citations").alias("chunk_id")).distinct()


def disguised_quotes(bench: DataFrame, chunks: DataFrame) -> DataFrame:
    """(vid, chunk_id): the quote reads the same as a passage of the cited chunk
    but is not in it character by character.

    Rows with a null vid, null, empty or invisible quote, null or empty
    citations, unknown chunks or null text give nothing.  Repeated rows count
    once.  Pairs with the quote in place are left out before any mapping."""
    quotes = bench.where(F.col("vid").isNotNull() & (F.col("quote") != "") & F.col("citations").isNotNull())
    texts = chunks.where(F.col("text").isNotNull()).select("chunk_id", "text")
    pairs = citations_of(quotes, F.col("quote")).join(texts, "chunk_id").where(~F.contains("text", "quote"))
    schema = T.StructType([T.StructField("vid", T.StringType()), T.StructField("chunk_id", T.StringType())])
    sql = """SELECT vid, chunk_id FROM (SELECT vid, chunk_id, visible(quote) AS q, visible(text) AS t FROM part)
             WHERE q <> '' AND contains(t, q)"""
    return _run_sql(pairs.select("vid", "chunk_id", "quote", "text"), sql, schema).distinct()

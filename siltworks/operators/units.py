"""Text units: the lines, paths and metadata in which rules look for things that stand together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.functions import paths
from siltworks.functions import text as T

LONGEST_LINE, SHORTEST_ALIAS, SHORTEST_KEYWORD, MOST_KEYWORDS = 300, 3, 2, 200
SECRET_ANCHORS = (
    "AKIA",
    "ghp_",
    "github_pat_",
    "mongodb",
    "PRIVATE KEY",
    "AIza",
    "sk_live_",
    "xox",
    "sk-ant-",
    "SG.",
    "postgres",
    "mysql",
    "api_key",
    "token",
    "secret",
    "password",
)
#: Where something was found, from the strongest evidence to the weakest.
LOCATIONS = (
    "repo_name", "description", "topics", "file_path", "readme", "file_content", "commit_message", "commit_author"
)


def exploded_lines(files: DataFrame, text: str = "content") -> DataFrame:
    """files with a row for each line: line_number from 1 and line."""
    kept = [c for c in files.columns if c != text]
    rows = files.select(*kept, F.posexplode(T.lines(F.col(text))).alias("line_number", "line"))
    return rows.withColumn("line_number", F.col("line_number") + 1)


def _entries(location: str, values: Column, at: Column | None = None) -> Column:
    """Structs of an array of texts that are one line each."""
    return F.transform(values, lambda v, i: F.struct(
        F.lit(LOCATIONS.index(location)).alias("rank"), i.cast("int").alias("entry"), F.lit(0).alias("line_number"), v.alias("text"), F.lit(None).cast("string").alias("path"),
    ))


def _lines(location: str, entry: Column, text: Column, path: Column) -> Column:
    return F.transform(T.lines(text), lambda v, i: F.struct(
        F.lit(LOCATIONS.index(location)).alias("rank"), entry.cast("int").alias("entry"), (i + 1).cast("int").alias("line_number"), v.alias("text"), path.alias("path"),
    ))


def unit_columns() -> Column:
    """All units of a row of the context table, in order of location, entry and line."""
    readme = F.when(
        F.length("readme_text") > 0,
        _lines("readme", F.lit(0), F.col("readme_text"), F.coalesce("readme_path", F.lit("README.md"))),
    )
    content = F.flatten(F.transform("files", lambda f, i: _lines("file_content", i + 1, f["content"], f["path"])))
    some = [
        _entries("repo_name", F.array("full_name")), _entries("description", F.array("description")), _entries("topics", F.col("topics")),
        _entries("file_path", F.col("file_paths")), readme, content,
    ]
    empty = F.array().cast("array<struct<rank:int,entry:int,line_number:int,text:string,path:string>>")
    whole = F.concat(*(F.coalesce(x, empty) for x in some))
    return F.filter(whole, lambda u: F.length(u["text"]) > 0)


def text_units(context: DataFrame) -> DataFrame:
    """Rows (repo_id, rank, entry, line_number, text, path) of a context table."""
    return context.select("repo_id", F.inline(unit_columns()))


def grep(files: DataFrame, terms: DataFrame, boundary: bool = True) -> DataFrame:
    """Rows (repo_id, path, line_number, term, line): lines of files(repo_id, path, content) that have a term.

    With boundaries, as a brand's aliases are searched: terms of three characters or more as
    words, the first term of a line alone. Without: up to 200 terms of two or more anywhere,
    each once a line. Terms(term, ord) are a dimension that an analyst keeps, so they meet
    every line by a broadcast; a line is cheaply tested for the bare term first.
    """
    shortest = SHORTEST_ALIAS if boundary else SHORTEST_KEYWORD
    wanted = terms.where(F.length("term") >= shortest)
    if not boundary:
        wanted = wanted.orderBy("ord").limit(MOST_KEYWORDS)
    rows = exploded_lines(files.where(~paths.is_excluded(F.col("path")))).where(F.length("line") > 0)
    hit = F.contains(F.lower("line"), F.lower("term"))
    if boundary:
        hit = hit & (T.word_index(F.col("line"), F.lower("term")) >= 0)
    found = rows.join(wanted, hit).withColumn("line", F.trim(F.substring("line", 1, LONGEST_LINE)))
    key = ["repo_id", "path", "line_number"] + ([] if boundary else ["term"])
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("ord"))
    return found.withColumn("_turn", turn).where("_turn = 1").select("repo_id", "path", "line_number", "term", "line")


def secret_candidates(files: DataFrame) -> DataFrame:
    """Lines that have the literal beginning of some secret."""
    rows = exploded_lines(files.where(~paths.is_excluded(F.col("path"))))
    hit = F.lit(False)
    for a in SECRET_ANCHORS:
        hit = hit | F.contains(F.lower("line"), F.lit(a.lower()))
    return rows.where(hit).select(
        "repo_id", "path", "line_number", F.trim(F.substring("line", 1, LONGEST_LINE)).alias("line")
    )

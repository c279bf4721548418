"""Markdown and text files as rows: course, curriculum, regulation and teacher files, and transcripts.

Every reader takes files (path, content), from files() or any table, and stays in column expressions: a file becomes
lines or blocks by explode, and headers are carried forward by windows within the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import grounding


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, content): whole files."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def kind(content: Column | str, path: Column | str) -> Column:
    """Which reader a file is for: its path's folder, else its first lines."""
    head = F.substring_index(text.col(content), "\n", 10)
    return (
        F.when(F.lower(text.col(path)).rlike("matriz|curricul"), "curriculum").when(head.rlike("(?m)^# Matriz Curricular"), "curriculum")
        .when(head.rlike(r"(?m)^\*\*C[óo]digo:"), "course").when(text.col(content).rlike(r"(?m)^### Prof"), "teacher").otherwise("regulation")
    )


def field(content: Column | str, name: str) -> Column:
    """The value of a line like **name:** value; missing, none, null and n/a are null."""
    value = text.strip(F.regexp_extract(text.col(content), rf"(?mi)^[-* ]*\*\*{name}:\*\*[ \t]*(.*)$", 1))
    return F.when(~F.lower(value).isin("", "none", "null", "n/a", "-"), value)


def section(content: Column | str, title: str) -> Column:
    """The text below a heading ## title, up to the next heading of that level."""
    return text.strip(F.regexp_extract(text.col(content), rf"(?si)(?:^|\n)##[ \t]+{title}[ \t]*\n(.*?)(?=\n##[ \t]|\z)", 1))


def items(block: Column) -> Column:
    """Items of a list, without the ones that say there are none."""
    found = F.regexp_extract_all(block, F.lit(r"(?m)^[-*][ \t]+(.+)$"), 1)
    return F.filter(F.transform(found, text.strip), lambda x: ~F.lower(x).rlike("^(nenhum|none|n/a)"))


def courses(files_: DataFrame) -> DataFrame:
    """(path, name, code, acronym, term, programmes, teachers, syllabus): one row per course file."""
    c = F.col("content")
    return files_.select(
        "path", text.strip(F.regexp_extract(c, r"(?m)^#[ \t]+(.+)$", 1)).alias("name"), field(c, "C[óo]digo").alias("code"), field(c, "Sigla").alias("acronym"),
        F.regexp_extract(F.coalesce(field(c, "Termo"), F.lit("")), r"^(\d+)", 1).try_cast("int").alias("term"),
        F.transform(F.split(F.coalesce(field(c, r"Curso\(s\)"), F.lit("")), ","), text.strip).alias("programmes"),
        items(section(c, "Docentes")).alias("teachers"), F.substring(section(c, "Ementa"), 1, 800).alias("syllabus"),
    )


def course_prerequisites(files_: DataFrame) -> DataFrame:
    """(course, prerequisite, code): list items of the prerequisites section, with the code in parentheses."""
    c = F.col("content")
    rows = files_.select(text.strip(F.regexp_extract(c, r"(?m)^#[ \t]+(.+)$", 1)).alias("course"), F.explode(items(section(c, "Pr[ée]-requisitos"))).alias("item"))
    return rows.select(
        "course", text.strip(F.regexp_replace("item", r"\s*\(.*\)\s*$", "")).alias("prerequisite"), F.nullif(F.regexp_extract("item", r"\(C[óo]digo:\s*([^)]+)\)", 1), F.lit("")).alias("code")
    )


def teachers(files_: DataFrame) -> DataFrame:
    """(name, email, room, area): one row per teacher and area."""
    block = F.explode(F.split("content", r"(?m)^(?=### Prof)")).alias("b")
    one = files_.select(block).where("b LIKE '### Prof%'")
    name = text.strip(F.regexp_replace(F.regexp_extract("b", r"(?m)^###[ \t]+(.+)$", 1), r"(?i)^(prof\.?[aª]?\.?|dra?\.?|me\.?|ms[ca]?\.?|[ \t])+(?=[A-ZÀ-Ú])", ""))
    area = F.explode_outer(F.filter(F.transform(F.split(field("b", "[ÁA]reas"), ","), text.strip), lambda a: a != ""))
    return one.select(name.alias("name"), field("b", "E-?mail").alias("email"), field("b", "Sala").alias("room"), area.alias("area"))


def curricula(files_: DataFrame) -> DataFrame:
    """(programme, acronym, term, course, credits): rows of the tables below headings ### Termo n; terms of other sections are null."""
    title = F.regexp_extract("content", r"(?m)^#[ \t]+(?:Matriz Curricular[ \t]*-[ \t]*)?([^(\n]+)", 1)
    acronym = F.regexp_extract("content", r"(?m)^#[^\n]*\(([^)]+)\)", 1)
    # what a file has once is taken before its lines are rows: beside an explode it would be taken from the whole text for each line
    once = files_.select("path", text.strip(title).alias("programme"), acronym.alias("acronym"), F.split("content", "\n").alias("lines"))
    lines = once.select("path", "programme", "acronym", F.posexplode("lines").alias("at", "line"))
    head = F.when(F.col("line").rlike("^#{2,3} "), F.regexp_replace("line", "^#+ *", ""))
    placed = lines.withColumn("head", F.last(head, ignorenulls=True).over(Window.partitionBy("path").orderBy("at")))
    cells = placed.where(r"line rlike '^\\|' AND NOT line rlike '^\\|[ :|-]+$'").withColumn("c", F.transform(F.split("line", r"\|"), text.strip))
    rows = cells.where("size(c) >= 4").select(
        "programme", "acronym", F.nullif(F.regexp_extract("head", r"(?i)^termo[ \t]+(\d+)", 1), F.lit("")).cast("int").alias("term"), F.col("c")[1].alias("course"), F.col("c")[2].try_cast("int").alias("credits")
    )
    return rows.where("credits IS NOT NULL AND course <> ''")


def articles(files_: DataFrame) -> DataFrame:
    """(path, number, body, heading): **Art. n.** blocks, with the nearest heading above and the articles each refers to."""
    lines = files_.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    order = Window.partitionBy("path").orderBy("at")
    number = F.nullif(F.regexp_extract("line", r"^\*\*Art\. *(\d+)", 1), F.lit("")).cast("int")
    heading = F.when(F.col("line").rlike("^### "), F.regexp_replace("line", "^### *", ""))
    marked = lines.withColumns({"number": F.last(number, ignorenulls=True).over(order), "heading": F.last(heading, ignorenulls=True).over(order)}).where("number IS NOT NULL AND NOT line rlike '^#'")
    joined = marked.groupBy("path", "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "\n").alias("body"), F.min_by("heading", "at").alias("heading")
    )
    body = text.strip(F.regexp_replace("body", r"^\*\*Art\. *\d+[^*]*\*\*", ""))
    refers = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"(?i)art\. *(\d+)"), 1), lambda n: n.cast("int"))))
    return joined.select("path", "number", "heading", F.substring(body, 1, 500).alias("body"), F.filter(refers, lambda n: n != F.col("number")).alias("refers_to"))


def organ_mentions(articles_: DataFrame, organs: DataFrame) -> DataFrame:
    """(path, number, organ): the organs that articles name as whole words, also by another name, not within a longer one. articles: as from articles(); organs: (name, organ)."""
    texts = articles_.select(F.struct("path", "number").alias("id"), F.col("body").alias("text"))
    found = grounding.outermost(grounding.spans(texts, organs.select("name", F.col("organ").alias("target"))))
    return found.select("id.path", "id.number", F.col("target").alias("organ")).distinct()


def questions(files_: DataFrame) -> DataFrame:
    """(path, at, question, answer): pairs of **Pergunta:** and **Resposta:**."""
    pair = r"(?s)\*\*Pergunta:\*\*(.*?)\*\*Resposta:\*\*(.*?)(?=\*\*Pergunta:|\n#|\z)"
    q = F.regexp_extract_all("content", F.lit(pair), 1)
    a = F.regexp_extract_all("content", F.lit(pair), 2)
    rows = files_.select("path", F.posexplode(F.arrays_zip(q.alias("q"), a.alias("a"))).alias("at", "p"))
    return rows.select("path", "at", text.strip("p.q").alias("question"), text.strip("p.a").alias("answer"))


def section_chunks(files_: DataFrame, least: int = 80) -> DataFrame:
    """(path, at, heading, text): the ## sections of any file, of at least `least` characters; headings without accents."""
    rows = files_.select("path", F.posexplode(F.split("content", r"(?m)^(?=##[ \t])")).alias("at", "b"))
    head = text.fold(text.strip(F.regexp_extract("b", r"^##[ \t]+(.+)", 1)))
    return rows.select("path", "at", head.alias("heading"), text.strip(F.regexp_replace("b", r"^##[^\n]*\n?", "")).alias("text")).where(F.length("text") >= least)


def transcripts(files_: DataFrame) -> DataFrame:
    """(path, year, half, code, course, credits, grade, status): lines of a transcript.

    A semester header like 2023/1 holds until the next; a line "code - NAME" names the course of the data line below it, which holds
    credits, grade (with a comma or point, or none) and status.
    """
    lines = files_.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    order = Window.partitionBy("path").orderBy("at")

    def last(c: Column) -> Column:
        return F.last(c, ignorenulls=True).over(order)

    term = F.when(text.strip("line").rlike(r"^\d{4}/[12]$"), text.strip("line"))
    named = F.when(F.col("line").rlike(r"^\s*\d+ - \S"), text.strip("line"))
    marked = lines.withColumns({"term": last(term), "named": last(named), "data": F.regexp_extract("line", r"(\d+)\s+(\d+[.,]\d+|-)\s+([A-Za-z]+)\s*$", 0)})
    one = marked.where("data <> '' AND named IS NOT NULL AND NOT line rlike '^ *[0-9]+ - '")
    part = lambda n: F.regexp_extract("data", r"^(\d+)\s+(\d+[.,]\d+|-)\s+([A-Za-z]+)", n)
    return one.select(
        "path", F.substring_index("term", "/", 1).cast("int").alias("year"), F.substring_index("term", "/", -1).cast("int").alias("half"),
        F.regexp_extract("named", r"^(\d+)", 1).alias("code"), text.strip(F.regexp_extract("named", r"^\d+ - (.+)$", 1)).alias("course"),
        part(1).cast("int").alias("credits"), F.replace(part(2), F.lit(","), F.lit(".")).try_cast("double").alias("grade"), part(3).alias("status"),
    )

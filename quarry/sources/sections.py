"""Typed documents for an index from Markdown files: what a course, a regulation or a curriculum file says, section by section, each with its own heading and facts.

Every reader takes files (path, content) and gives (path, at, kind, title, text): at numbers a file's documents; title is the heading that a part stands under, carried forward to it by a window. Sentences
that only say the same in other words are left out. Null contents give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import splitting
from quarry.sources import markdown

#: Section titles, and fields, of the files; the least characters of a section of its own; the most of one document of it.
FIELDS = {"C[óo]digo": "Código", "Sigla": "Sigla", "Campus": "Campus", r"Curso(?:\(s\))?": "Curso", "Termo": "Termo", "Turno": "Turno", "Tipo": "Tipo"}
HOURS = {"Total": "Total", "Te[óo]rica": "Teórica", "Pr[áa]tica": "Prática", "Extens[ãa]o": "Extensão"}
REGULATION_FIELDS = {"Resolu[cç][aã]o": "Resolucao", "Institui[cç][aã]o": "Instituicao", "Campus": "Campus", "Data Vig[eê]ncia": "Data Vigencia", "Data Aprova[cç][aã]o": "Data Aprovacao", "Status": "Status"}
OWN_SECTIONS = ("Objetivo", "Estrutura", "Perguntas Frequentes")
ELECTIVES = ("Eletivas do Grupo 1", "Eletivas do Grupo 2", "Eletivas do Grupo 3", "Eletivas Extensionistas")
LEAST, MOST = 80, 1400


def _section(content: Column, title: str, level: int = 2) -> Column:
    """The text below a heading, up to the next of its level or above; null without one."""
    found = F.regexp_extract(content, rf"(?s)(?:^|\n)#{{{level}}}[ \t]+{title}[^\n]*\n(.*?)(?=\n#{{1,{level}}}[ \t]|\z)", 1)
    return F.when(content.rlike(rf"(?m)^#{{{level}}}[ \t]+{title}"), text.strip(found))


def _title(content: Column) -> Column:
    return F.coalesce(F.nullif(text.strip(F.regexp_extract(content, r"(?m)^#[ \t]+(.+)$", 1)), F.lit("")), F.lit("N/A"))


def _lines(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def _listed(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows: (path, place, kind, title, text), place a struct to order by."""
    at = (F.row_number().over(Window.partitionBy("path").orderBy("place")) - 1).cast("int")
    return rows.select("path", at.alias("at"), "kind", "title", "text")


def _documents(files_: DataFrame, docs: list[tuple[str, Column]], first: int = 0) -> DataFrame:
    """One row for each of the documents (kind, text) whose text isn't null."""
    none = F.lit(None).cast("string")
    each = F.array(*(F.struct(F.struct(F.lit(first + k).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("place"), F.lit(kind).alias("kind"), none.alias("title"), body.alias("text")) for k, (kind, body) in enumerate(docs)))
    return files_.where("content IS NOT NULL").select("path", F.explode(F.filter(each, lambda d: d["text"].isNotNull())).alias("d")).select("path", "d.*")


def course_documents(files_: DataFrame) -> DataFrame:
    """Up to seven documents of a course file: info, teachers, prerequisites (if any), hours, syllabus, basic and further bibliography (if there)."""
    c = F.col("content")
    name, code = _title(c), F.coalesce(markdown.field(c, "C[óo]digo"), F.lit("N/A"))
    head = F.concat(F.lit("DISCIPLINA: "), name, F.lit(" (Código: "), code, F.lit(")"))
    listed = lambda title: F.transform(F.regexp_extract_all(F.coalesce(_section(c, title), F.lit("")), F.lit(r"(?m)^[ \t]*-[ \t]*(.+)$"), 1), text.strip)
    teachers, needs = listed("Docentes"), listed("Pr[ée]-requisitos")
    facts = [F.concat(F.lit(f"{label}: "), markdown.field(c, pattern)) for pattern, label in FIELDS.items()]
    block = F.coalesce(_section(c, "Carga Hor[áa]ria"), F.lit(""))
    hours = [F.concat(F.lit(f"- {label}: "), F.coalesce(markdown.field(block, pattern), F.lit("N/A"))) for pattern, label in HOURS.items()]
    syllabus = _section(c, "Ementa")
    topics = F.transform(F.regexp_extract_all(F.coalesce(_section(c, "T[óo]picos", 3), F.lit("")), F.lit(r"(?m)^[ \t]*-[ \t]*(.+)$"), 1), text.strip)
    books = lambda kind: _section(F.concat(F.lit("\n"), F.coalesce(_section(c, "Bibliografia"), F.lit(""))), kind, 3)
    none = F.lit("Informação não disponível")
    joined = lambda items, sep: F.when(F.size(items) > 0, F.array_join(items, sep))
    return _numbered(_documents(files_, [
        ("info", _lines(F.concat(F.lit("DISCIPLINA: "), name), *facts, F.concat(F.lit("DOCENTES: "), F.coalesce(joined(teachers, ", "), F.lit("N/A"))), F.concat(F.lit("PRÉ-REQUISITOS: "), F.coalesce(joined(needs, "; "), F.lit("Nenhum"))), *hours)),
        ("teachers", _lines(head, F.lit("DOCENTES:"), F.when(F.size(teachers) > 0, _listed(teachers)).otherwise(none))),
        ("prerequisites", F.when(F.size(needs) > 0, _lines(head, F.lit("PRÉ-REQUISITOS:"), _listed(needs)))),
        ("hours", _lines(head, F.lit("CARGA HORÁRIA:"), *hours)),
        ("syllabus", F.when(syllabus.isNotNull(), _lines(head, F.lit("EMENTA:"), text.strip(F.regexp_replace(syllabus, r"(?s)(?:^|\n)###.*", "")), F.when(F.size(topics) > 0, F.concat(F.lit("TÓPICOS:\n"), _listed(topics)))))),
        *((kind, F.when(books(title).isNotNull(), _lines(head, F.lit(f"{label}:"), books(title)))) for kind, title, label in (("bibliography_basic", "B[áa]sica", "BIBLIOGRAFIA BÁSICA"), ("bibliography_further", "Complementar", "BIBLIOGRAFIA COMPLEMENTAR"))),
    ]))


def regulation_documents(files_: DataFrame) -> DataFrame:
    """Documents of a regulation file: info, objective, an article each with the nearest ### heading before it, a question each with the article last named, a summary of the headings, and
    the other sections of LEAST characters or more in packs of paragraphs. A file with nothing but info and summary is packed whole."""
    c = F.col("content")
    some = files_.where("content IS NOT NULL")
    name = F.concat(F.lit("DOCUMENTO: "), _title(c))
    facts = [F.concat(F.lit(f"{label}: "), markdown.field(c, pattern)) for pattern, label in REGULATION_FIELDS.items()]
    objective, headings = _section(c, "Objetivo"), F.regexp_extract_all(c, F.lit(r"(?m)^##[ \t]+(.+)$"), 1)
    fixed = _documents(some, [("info", _lines(name, *facts)), ("objective", F.when(objective != "", _lines(name, F.concat(F.lit("OBJETIVO: "), objective))))])
    summary = _documents(some, [("summary", _lines(name, F.when(F.size(headings) > 0, _listed(F.transform(headings, text.strip)))))], first=4)
    place = lambda a: F.struct(F.lit(a).alias("a"), F.col("i").alias("b"), F.lit(0).alias("c")).alias("place")
    order = Window.partitionBy("path").orderBy("i")

    pieces = some.select("path", name.alias("name"), F.posexplode(F.split(F.concat(F.lit("\n"), F.coalesce(_section(c, "Estrutura"), F.lit(""))), r"(?=\n###[ \t])|(?=\*\*Art\. \d+\.\*\*)")).alias("i", "p"))
    under = pieces.withColumn("title", F.last(F.nullif(text.strip(F.regexp_extract("p", r"^\n###[ \t]+([^\n]+)", 1)), F.lit("")), ignorenulls=True).over(order))
    article = under.withColumns({"number": F.regexp_extract("p", r"^\*\*Art\. (\d+)\.\*\*", 1), "body": text.strip(F.regexp_extract("p", r"(?s)^\*\*Art\. \d+\.\*\*(.*)", 1))}).where("number <> '' AND body <> ''")
    title = F.coalesce("title", F.lit("Geral"))
    articles = article.select("path", place(2), F.lit("article").alias("kind"), title.alias("title"), _lines(F.col("name"), F.concat(F.lit("SEÇÃO: "), title), F.format_string("Art. %s. %s", "number", "body")).alias("text"))

    blocks = some.select("path", name.alias("name"), F.posexplode(F.split(F.coalesce(_section(c, "Perguntas Frequentes"), F.lit("")), r"(?=\*\*(?:Artigo|Pergunta):\*\*)")).alias("i", "p"))
    told = blocks.withColumns({
        "article": F.last(F.nullif(F.regexp_extract("p", r"\*\*Artigo:\*\*\s*(\d+)", 1), F.lit("")), ignorenulls=True).over(order),
        "question": text.strip(F.regexp_extract("p", r"(?s)\*\*Pergunta:\*\*\s*(.+?)(?:\s*\n|\s{2,}|\*\*Resposta)", 1)), "answer": text.strip(F.regexp_extract("p", r"(?s)\*\*Resposta:\*\*\s*(.+?)(?:\s*$|\n\n)", 1)),
    }).where("question <> '' AND answer <> ''")
    faq = told.select("path", place(3), F.lit("question").alias("kind"), F.col("article").alias("title"), _lines(F.col("name"), F.concat(F.lit("Artigo: "), F.col("article")), F.concat(F.lit("PERGUNTA: "), F.col("question")), F.concat(F.lit("RESPOSTA: "), F.col("answer"))).alias("text"))

    parts = some.select("path", name.alias("name"), F.posexplode(F.split(c, r"(?m)^(?=##[ \t])")).alias("i", "p"))
    other = parts.withColumns({"title": text.strip(F.regexp_extract("p", r"^##[ \t]+(.+)", 1)), "body": text.strip(F.regexp_replace("p", r"^##[^\n]*\n?", ""))})
    other = other.where((F.col("title") != "") & ~F.col("title").isin(*OWN_SECTIONS) & (F.length("body") >= LEAST)).select("path", "name", "i", "title", "body")
    kept = fixed.unionAll(articles).unionAll(faq)
    # what has none of these but its info
    bare = some.join(kept.where("kind <> 'info'").select("path").unionAll(other.select("path")).distinct(), "path", "left_anti")
    whole = bare.select("path", name.alias("name"), F.lit(0).alias("i"), F.lit(None).cast("string").alias("title"), text.strip(F.regexp_replace(c, r"(?m)\A\s*#[ \t].*$", "")).alias("body"))
    packed = splitting.pack(other.unionAll(whole), MOST, "body")
    body = packed.select("path", F.struct(F.lit(5).alias("a"), F.col("i").alias("b"), F.col("chunk").alias("c")).alias("place"), F.lit("content").alias("kind"), "title", _lines(F.col("name"), F.concat(F.lit("SEÇÃO: "), F.col("title")), F.col("chunk_text")).alias("text"))
    return _numbered(kept.unionAll(summary).unionAll(body))


def curriculum_documents(files_: DataFrame) -> DataFrame:
    """Documents of a curriculum file: a summary, one for each term with its courses and credits, and one for each group of electives that has a section."""
    c = F.col("content")
    some = files_.where("content IS NOT NULL")
    acronym, hours = F.regexp_extract(_title(c), r"\(([A-Z]{2,5})\)", 1), F.regexp_extract(c, r"\*\*Carga Hor[áa]ria Total:\*\*\s*(\d+)", 1)
    term = r"(?m)^###[ \t]+(?:Termo[ \t]+)?(\d+)[º°]?[^\n]*"
    terms = F.size(F.regexp_extract_all(c, F.lit(term), 1))
    first = _documents(some, [("summary", _lines(F.concat(F.lit("# "), _title(c)), F.concat(F.lit("Sigla: "), F.nullif(acronym, F.lit(""))), F.concat(F.lit("Carga Horária Total: "), F.nullif(hours, F.lit("")), F.lit(" horas")), F.concat(F.lit("Duração: "), terms.cast("string"), F.lit(" termos"))))])
    blocks = some.select("path", _title(c).alias("name"), F.posexplode(F.split(c, r"(?m)(?=^###[ \t])|(?=^##[ \t])|(?=^---)")).alias("i", "p")).withColumn("title", F.regexp_extract("p", rf"\A{term}", 1)).where("title <> ''")
    rows = F.regexp_extract_all("p", F.lit(r"(?m)^\|[ \t]*([^|\n]+?)[ \t]*\|[ \t]*\d+[ \t]*\|"), 1), F.regexp_extract_all("p", F.lit(r"(?m)^\|[ \t]*[^|\n]+?[ \t]*\|[ \t]*(\d+)[ \t]*\|"), 1)
    found = F.filter(F.arrays_zip(rows[0].alias("name"), rows[1].alias("credits")), lambda r: ~r["name"].startswith("-") & (r["name"] != "Disciplina"))
    listed = F.array_join(F.transform(found, lambda r: F.concat(F.lit("- "), r["name"], F.lit(" ("), r["credits"], F.lit(" créditos)"))), "\n")
    by_term = blocks.where(F.size(found) > 0).select("path", F.struct(F.lit(1).alias("a"), F.col("i").alias("b"), F.lit(0).alias("c")).alias("place"), F.lit("term").alias("kind"), "title", _lines(F.concat(F.lit("Termo "), F.col("title"), F.lit(" - "), F.col("name")), listed).alias("text"))
    electives = _documents(some, [("electives", F.when(_section(c, s).isNotNull(), _lines(F.concat(F.lit(f"{s} - "), _title(c)), _section(c, s)))) for s in ELECTIVES], first=2)
    return _numbered(first.unionAll(by_term).unionAll(electives))


def documents(files_: DataFrame) -> DataFrame:
    """(path, at, kind, title, text) of files of all three sorts, told apart as markdown.kind does."""
    sorted_ = files_.withColumn("sort", markdown.kind("content", "path"))
    of = lambda sort: sorted_.where(F.col("sort") == sort).drop("sort")
    return course_documents(of("course")).unionAll(regulation_documents(of("regulation"))).unionAll(curriculum_documents(of("curriculum")))

"""Classification and routing of questions by ordered rules, dictionaries and centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text


def first_match(c: Column | str, rules: list[tuple[str, tuple[str, ...]]], default: str | None = None) -> Column:
    """The name of the first rule one of whose phrases stands in the text."""
    found = F.lit(default)
    for name, phrases in reversed(rules):
        found = F.when(text.phrase(c, *phrases), name).otherwise(found)
    return found


def longest_synonym(texts: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(id, axis): the axis whose longest synonym stands in the text, ties by axis. texts: (id, text); synonyms: (axis, synonym), fixed and small."""
    hit = texts.join(F.broadcast(synonyms), F.lower("text").contains(F.col("synonym")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.length("synonym")), "axis"))
    return hit.withColumn("r", rank).where("r = 1").select("id", "axis", "synonym")


def last_content_words(c: Column | str, n: int = 3, stop_words: tuple[str, ...] = ("the", "of", "and", "a", "to", "in")) -> Column:
    """The last n words that carry content, as the term of a question."""
    words = F.filter(F.split(text.text_key(c), " "), lambda w: (F.length(w) > 2) & ~w.isin(*stop_words))
    return F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n), " ")


def activities(c: Column | str) -> Column:
    """Array of (item, hours) from a list in prose: parts between commas, semicolons or line feeds with a number of hours."""
    parts = F.split(text.col(c), r",\s+|[;\n]")
    found = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_replace(p, r"\d+([.,]\d+)?\s*h(ours)?", "")).alias("item"), F.expr("1.0D").alias("hours"), F.regexp_extract(p, r"(\d+([.,]\d+)?)\s*h", 1).alias("raw")))
    return F.transform(F.filter(found, lambda s: s["raw"] != ""), lambda s: F.struct(s["item"].alias("item"), F.replace(s["raw"], F.lit(","), F.lit(".")).cast("double").alias("hours")))


#: Where a list of activities is cut (at marks, line feeds, and before a number), its hours, and the institution that it names.
CUT = r"[;\n]+|,\s+(?=\d)|\.\s+(?=\d)|\s+e\s+(?:tamb[eé]m\s+)?(?:tenho\s+)?(?=\d)|,\s+(?:tamb[eé]m\s+)?(?:tenho\s+)?(?=\d)"
HOURS = r"(\d+(?:[.,]\d+)?)\s*h(?:oras?|rs?)?\b"
INSTITUTION = r"\b(?:na|no|pela|pelo|da|do)\s+([A-ZÀ-Ú][\p{L}\p{N}_.&-]*(?:\s+[A-ZÀ-Ú][\p{L}\p{N}_.&-]*)*)"


def declared_activities(c: Column | str) -> Column:
    """Array of (item, hours, institution) from a list in prose; parts without hours, or with none, are left out. The item is the part as it stands."""
    parts = F.transform(F.split(text.col(c), CUT), lambda p: F.regexp_replace(p, r"^[ .,-]+|[ .,-]+$", ""))
    found = F.transform(
        parts,
        lambda p: F.struct(
            p.alias("item"), F.replace(F.nullif(F.regexp_extract(p, HOURS, 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double").alias("hours"),
            F.nullif(F.trim(F.regexp_extract(p, INSTITUTION, 1)), F.lit("")).alias("institution"),
        ),
    )
    return F.filter(found, lambda a: (a["item"] != "") & (a["hours"] > 0))


#: Accepted activities by axis, each with what a description of it may hold, in lower case without accents. Names of a school's own associations are the caller's to add.
ACCEPTED: list[tuple[int, str, list[str]]] = [
    (1, "doação de sangue", ["doacao de sangue", "doei sangue", "doar sangue", "medula", "redome", "hemocentro"]),
    (1, "atividades artísticas", ["teatro", "danca", "canto", "coral", "banda", "musica", "instrumental", "circo", "performatic", "artistic"]),
    (1, "concursos culturais ou exposições", ["concurso cultural", "exposicao", "mostra cultural"]),
    (1, "serviços sociais e voluntariado", ["voluntari", "ong", "servico social", "acao social", "trabalho comunitario", "igreja", "pastoral"]),
    (1, "atividades de extensão", ["projeto de extensao", "programa de extensao", "acao de extensao", "atividade de extensao", "atividades de extensao", "siex", "extensao universitaria", "curso de extensao"]),
    (1, "organização de eventos externos", ["organizacao de evento", "organizei evento", "organizar evento"]),
    (1, "centro acadêmico ou atlética", ["centro academico", "atletica", "bateria universitaria"]),
    (2, "monitoria, tutoria ou orientação", ["monitoria", "monitor", "tutor", "tutoria", "orientador academico"]),
    (2, "recepção de estudantes estrangeiros", ["mobilidade internacional", "estudantes estrangeiros", "intercambistas"]),
    (2, "atividades da DAE", ["dae"]),
    (2, "atividades do NAE ou NAI", ["nae", "nai", "assistencia estudantil", "acessibilidade e inclusao"]),
    (2, "orientação sobre os cursos para ensino médio", ["ensino medio", "divulgacao dos cursos", "feira de profissoes"]),
    (2, "recepção de calouros e matrículas", ["recepcao de calouros", "acolhimento de calouros", "semana de recepcao", "matricula de ingressantes"]),
    (3, "iniciação científica", ["iniciacao cientifica", "ic ", " ic,", " ic.", "pibic", "pibiti", "bolsista de pesquisa", "pd&i", "pdi", "embrapii", "projeto de pesquisa"]),
    (3, "empresa júnior ou startup", ["empresa junior", "startup", "start up", "start-up"]),
    (3, "eventos científicos como ouvinte", ["congresso", "palestra", "ouvinte", "workshop", "semana academica", "evento cientifico", "seminario"]),
    (3, "apresentação de trabalhos", ["apresentacao de trabalho", "apresentei trabalho", "poster", "artigo em congresso"]),
    (3, "competições científicas e tecnológicas", ["competicao", "maratona de programacao", "hackathon", "olimpiada", "torneio de robotica"]),
    (3, "estágio não obrigatório", ["estagio"]),
    (3, "atividade profissional em C&T", ["atividade profissional", "clt", "carteira assinada", "emprego", "trabalho em empresa", "jovem aprendiz"]),
    (3, "cursos de línguas estrangeiras", ["ingles", "espanhol", "frances", "alemao", "idioma", "lingua estrangeira", "curso de lingua"]),
    (3, "UC optativa", ["optativa", "unidade curricular optativa"]),
    (3, "cursos e capacitações", ["curso online", "curso de", "certificacao", "capacitacao", "treinamento", "bootcamp", "alura", "coursera", "udemy"]),
]


def accepted_activity(c: Column | str, accepted: list[tuple[int, str, list[str]]] | None = None) -> Column:
    """struct(axis, activity) of the accepted activity with the longest key that a description holds, ties to the first; null if it holds none."""
    rows = [(axis, activity, key) for axis, activity, keys in accepted or ACCEPTED for key in keys]
    # the longest first, so that the first that is held is it
    rows.sort(key=lambda r: -len(r[2]))
    said = F.concat(F.lit(" "), text.text_key(F.coalesce(text.col(c), F.lit(""))), F.lit(" "))
    table = F.array(*(F.struct(F.lit(axis).alias("axis"), F.lit(activity).alias("activity"), F.lit(key).alias("key")) for axis, activity, key in rows))
    first = F.transform(F.array(said), lambda s: F.get(F.filter(table, lambda r: F.contains(s, r["key"])), F.lit(0)))
    found = F.get(first, F.lit(0))
    return F.when(found.isNotNull(), F.struct(found["axis"].alias("axis"), found["activity"].alias("activity")))

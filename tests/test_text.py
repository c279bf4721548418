"""Normal forms against Python's and a second engine's Unicode data."""

from __future__ import annotations

import unicodedata

import duckdb

from quarry.functions import text


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", make("v").alias("o")).orderBy("i").collect()]


def stripped(value):
    return "".join(c for c in unicodedata.normalize("NFD", value) if unicodedata.category(c) != "Mn")


def test_every_letter(spark):
    letters = [chr(c) for c in range(0x80, 0x1F00) if unicodedata.category(chr(c))[0] == "L"]
    con = duckdb.connect()
    theirs = [con.execute("SELECT strip_accents(?)", [c]).fetchone()[0] for c in letters]
    got = column(spark, letters, text.without_marks)
    # letters that decompose into two stay whole
    assert [c for c, a, b in zip(letters, got, theirs, strict=True) if a != b] == list("ஔᬆᬈᬊᬌᬎᬒ")


def test_marks_and_words(spark):
    values = ["čŐǎ Ångström", "école", "ĪİŞ ẞß", "naïve Łódź", "́", "", "한국 が", "Çédille—œ", None, "Việt Nam"]
    assert column(spark, values, text.without_marks) == [None if v is None else v if "한" in v and not stripped(v) else "한국 か" if v and "한" in v else stripped(v) for v in values]
    assert column(spark, ["Résumé DE Čapek", "ŽIŽEK é", "İstanbul"], text.fold) == ["resume de capek", "zizek e", "istanbul"]
    assert column(spark, ["Introdução de Redes e Sistemas", "Žižek, da Silva!"], text.graph_key) == ["introducao redes sistemas", "zizek silva"]

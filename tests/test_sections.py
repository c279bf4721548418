"""Golden files for each kind of typed document."""

from __future__ import annotations

from quarry.sources import sections

COURSE = """# Bioquímica

**Código:** 5845
**Campus:** Sul
**Curso(s):** BCT, BBT
**Termo:** 3º
**Sigla:** BQ

## Docentes

- Ana Souza
- Bia

## Pré-requisitos

- Química (Código: 1)

## Carga Horária

- **Total:** 72h
- **Prática:** 36h

## Ementa

Texto da ementa.

### Tópicos

- Um
- Dois

## Bibliografia

### Basica

1. Livro A
2. Livro B

### Complementar

1. Livro C
"""
HEAD = "DISCIPLINA: Bioquímica (Código: 5845)"
HOURS = "- Total: 72h\n- Teórica: N/A\n- Prática: 36h\n- Extensão: N/A"
COURSE_DOCS = [
    ("info", None, f"DISCIPLINA: Bioquímica\nCódigo: 5845\nSigla: BQ\nCampus: Sul\nCurso: BCT, BBT\nTermo: 3º\nDOCENTES: Ana Souza, Bia\nPRÉ-REQUISITOS: Química (Código: 1)\n{HOURS}"),
    ("teachers", None, f"{HEAD}\nDOCENTES:\n- Ana Souza\n- Bia"),
    ("prerequisites", None, f"{HEAD}\nPRÉ-REQUISITOS:\n- Química (Código: 1)"),
    ("hours", None, f"{HEAD}\nCARGA HORÁRIA:\n{HOURS}"),
    ("syllabus", None, f"{HEAD}\nEMENTA:\nTexto da ementa.\nTÓPICOS:\n- Um\n- Dois"),
    ("bibliography_basic", None, f"{HEAD}\nBIBLIOGRAFIA BÁSICA:\n1. Livro A\n2. Livro B"),
    ("bibliography_further", None, f"{HEAD}\nBIBLIOGRAFIA COMPLEMENTAR:\n1. Livro C"),
]
LONG = "\n\n".join(f"Parágrafo {i} " + "x" * 700 for i in range(3))
REGULATION = f"""# Regimento da Pós

**Resolucao:** 12/2020
**Campus:** Sul

## Objetivo

Regular.

## Estrutura

**Art. 1.** Antes de tudo.
### Título I
**Art. 2.** Segundo
em duas linhas.
### Título II
**Art. 3.** Terceiro, ver Art. 2.

## Perguntas Frequentes

**Artigo:** 2 **Pergunta:** Como?
**Resposta:** Assim.

**Pergunta:** Quando?
**Resposta:** Já.

**Pergunta:** Sem resposta?

## Curta

pouco

## Prazos

{LONG}
"""
NAME = "DOCUMENTO: Regimento da Pós"
PARAGRAPHS = LONG.split("\n\n")
REGULATION_DOCS = [
    ("info", None, f"{NAME}\nResolucao: 12/2020\nCampus: Sul"),
    ("objective", None, f"{NAME}\nOBJETIVO: Regular."),
    ("article", "Geral", f"{NAME}\nSEÇÃO: Geral\nArt. 1. Antes de tudo."),
    ("article", "Título I", f"{NAME}\nSEÇÃO: Título I\nArt. 2. Segundo\nem duas linhas."),
    ("article", "Título II", f"{NAME}\nSEÇÃO: Título II\nArt. 3. Terceiro, ver Art. 2."),
    ("question", "2", f"{NAME}\nArtigo: 2\nPERGUNTA: Como?\nRESPOSTA: Assim."),
    ("question", "2", f"{NAME}\nArtigo: 2\nPERGUNTA: Quando?\nRESPOSTA: Já."),
    ("summary", None, f"{NAME}\n- Objetivo\n- Estrutura\n- Perguntas Frequentes\n- Curta\n- Prazos"),
    ("content", "Prazos", f"{NAME}\nSEÇÃO: Prazos\n{PARAGRAPHS[0]}"),
    ("content", "Prazos", f"{NAME}\nSEÇÃO: Prazos\n{PARAGRAPHS[1]}"),
    ("content", "Prazos", f"{NAME}\nSEÇÃO: Prazos\n{PARAGRAPHS[2]}"),
]
CURRICULUM = """# Matriz Curricular - Computação (BCC)

**Carga Horária Total:** 3200 horas

## Fixas

### Termo 1

| Disciplina | Créditos |
|---|---|
| Cálculo | 6 |
| Lógica | 4 |

### 2º Semestre

| Disciplina | Créditos |
|---|---|
| Álgebra | 4 |

### Termo 3

sem tabela

---

## Eletivas do Grupo 2

- Uma
- Outra
"""
TITLE = "Matriz Curricular - Computação (BCC)"
CURRICULUM_DOCS = [
    ("summary", None, f"# {TITLE}\nSigla: BCC\nCarga Horária Total: 3200 horas\nDuração: 3 termos"),
    ("term", "1", f"Termo 1 - {TITLE}\n- Cálculo (6 créditos)\n- Lógica (4 créditos)"),
    ("term", "2", f"Termo 2 - {TITLE}\n- Álgebra (4 créditos)"),
    ("electives", None, f"Eletivas do Grupo 2 - {TITLE}\n- Uma\n- Outra"),
]


def read(spark, make, **files):
    rows = make(spark.createDataFrame(list(files.items()), "path string, content string")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.path, r.at)):
        out.setdefault(r.path, []).append((r.at, r.kind, r.title, r.text))
    for docs in out.values():
        assert [d[0] for d in docs] == list(range(len(docs)))
    return {p: [d[1:] for d in docs] for p, docs in out.items()}


def test_courses(spark):
    got = read(spark, sections.course_documents, full=COURSE, bare="nothing", null=None)
    assert got["full"] == COURSE_DOCS
    assert [k for k, _, _ in got["bare"]] == ["info", "teachers", "hours"] and "null" not in got
    assert got["bare"][1][2].endswith("DOCENTES:\nInformação não disponível")


def test_regulations(spark):
    got = read(spark, sections.regulation_documents, full=REGULATION, plain="# Só texto\n\num parágrafo\n\noutro", null=None)
    assert got["full"] == REGULATION_DOCS
    assert got["plain"] == [("info", None, "DOCUMENTO: Só texto"), ("summary", None, "DOCUMENTO: Só texto"), ("content", None, "DOCUMENTO: Só texto\num parágrafo\n\noutro")]


def test_curricula(spark):
    assert read(spark, sections.curriculum_documents, full=CURRICULUM)["full"] == CURRICULUM_DOCS


def test_dispatch(spark):
    got = read(spark, sections.documents, **{"a/course.md": COURSE, "a/rules.md": REGULATION, "a/matriz_x.md": CURRICULUM})
    assert got == {"a/course.md": COURSE_DOCS, "a/rules.md": REGULATION_DOCS, "a/matriz_x.md": CURRICULUM_DOCS}

"""Questions in Portuguese: intents and their terms by ordered rules, routing by phrases, requests by detectors, lists in prose.

All rules are tables of patterns over one normal form of the text (`asked`): lower case, no accents, single spaces. So each is an ordered CASE of built-in
regular expressions, and callers may pass tables of their own. The patterns are in the subset that Java and RE2 read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators.names import containing

Rules = list[tuple[str, list[str]]]

_DE, _END = "(?:de|da|do)", r"(?:\?|$)"
_TEACHER = "(?:professor(?:a)?|docente)"
_TEACHERS = "(?:professore?s?|docentes?)"
_GIVES = "(?:leciona|ensina|ministra|da)"
_TERM = "(?:termo|semestre|periodo)"
_ORDINAL = "primeir[oa]|segund[oa]|terceir[oa]|quart[oa]|quint[oa]|sext[oa]|setim[oa]|oitav[oa]|non[oa]|decim[oa]"
_DONE = "(?:fiz|cursei|concluis?)"

#: Intents in the order in which they are tried, each with patterns whose groups hold its term.
INTENTS: Rules = [
    ("recommended_before", [
        rf"(?:bom|legal|util|recomendad[oa]s?|indicad[oa]s?) (?:fazer|cursar|estudar|ter feito) antes de (?:fazer |cursar )?(.+?){_END}",
        rf"o que ajuda(?:ria)? (?:a )?(?:fazer|cursar|estudar)? ?antes de (?:fazer |cursar )?(.+?){_END}",
        rf"vale a pena (?:fazer|cursar) (?:o que )?antes de (.+?){_END}",
        rf"recomendad[oa]s? antes de (.+?){_END}",
    ]),
    ("prerequisite_chain", [
        rf"(?:o que|quais? disciplinas?) (?:preciso|precisa|devo|deve) (?:fazer|cursar|ter) (?:antes de|para fazer|para cursar) (.+?){_END}",
        rf"pre[- ]?requisitos? (?:de|da|do|para) (.+?){_END}",
        rf"(?:preciso|precisa) (?:ter feito|ter cursado|cursar|fazer) (?:o que )?(?:antes (?:de|para) (?:cursar|fazer) )?(.+?){_END}",
    ]),
    ("dependents", [
        rf"disciplinas? (?:que )?depend(?:e|em) {_DE} (.+?){_END}",
        rf"disciplinas? (?:que )?(?:usam?|precisam?|requerem?|exigem?) (.+?) como pre[- ]?requisito{_END}",
        rf"(?:para )?(?:o )?que (.+?) e pre[- ]?requisito{_END}",
        rf"^(?:o que )?(.+?) desbloqueia{_END}",
        rf"^(?:o que )?(.+?) e pre[- ]?requisito (?:de que|para que|de qua(?:l|is)){_END}",
    ]),
    ("docente_disciplines", [
        rf"(?:disciplinas?|materias?) (?:que )?(?:o |a )?{_TEACHER}? ?(.+?) {_GIVES}{_END}",
        rf"(?:o que|quais?) (?:o |a )?(.+?) {_GIVES}{_END}",
    ]),
    ("discipline_docentes", [
        rf"(?:professor(?:es|a)?|docentes?) responsave(?:l|is) (?:por|pel[ao]) (?:a |o )?(?:(?:disciplina|materia) (?:de )?)?(.+?){_END}",
        rf"quem (?:e )?(?:o |a )?responsavel (?:por|pel[ao]) (?:a |o )?(?:(?:disciplina|materia) (?:de )?)?(.+?){_END}",
        rf"quem {_GIVES} (.+?){_END}",
        rf"{_TEACHERS} (?:de|da|do|que dao) (.+?){_END}",
        rf"{_TEACHERS} (?:que )?(?:lecionam?|ensinam?|ministram?|dao) (.+?){_END}",
    ]),
    ("docente_leciona_disciplina", [
        rf"{_TEACHER} (.+?) leciona (.+?){_END}",
        rf"(?:o |a )?([a-z]{{2,}}(?: [a-z]{{2,}})*) {_GIVES} (.+?){_END}",
    ]),
    ("artigos_sobre", [
        rf"artigos? (?:sobre|que (?:falam?|tratam?|mencionam?)) (.+?){_END}",
        rf"(?:o que|quais?) (?:os? )?(?:artigos?|regras?|normas?) (?:dizem?|falam?) sobre (.+?){_END}",
    ]),
    ("faqs", [
        rf"(?:frequentes?|comuns?) sobre (.+?){_END}",
        rf"(?:duvidas? )?(?:comuns? )?sobre (.+?){_END}",
    ]),
    ("docentes_by_area", [
        rf"{_TEACHERS} (?:que )?(?:trabalham?|pesquisam?|sao especialistas?) (?:com|em) (.+?){_END}",
        rf"(?:trabalha|pesquisa|e especialista) (?:com|em) (.+?){_END}",
        rf"especialistas? (?:em|de) (.+?){_END}",
    ]),
    ("docente_areas", [
        rf"areas? (?:de )?(?:especializacao|pesquisa|atuacao) {_DE} {_TEACHER}? ?(.+?){_END}",
        rf"(?:em que|quais? areas?) (?:o |a )?(.+?) (?:pesquisa|trabalha|atua|e especialista){_END}",
        rf"areas? {_DE} (?:o |a )?{_TEACHER}? ?(.+?){_END}",
        r"quero fazer (?:uma? )?(?:ic|iniciacao cientifica) com (?:o |a )?(.+?)[.,] ?(?:qual|pode me dizer) (?:a )?area",
    ]),
    ("docente_info", [
        rf"e[- ]?mail {_DE} (?:o |a )?{_TEACHER}? ?(.+?){_END}",
        rf"(?:qual|onde) (?:e )?(?:a )?sala {_DE} (?:o |a )?{_TEACHER}? ?(.+?){_END}",
        rf"onde fica (?:a sala )?{_DE} (?:o |a )?{_TEACHER}? ?(.+?){_END}",
        rf"contato (?:com )?(?:o |a )?{_TEACHER}? ?(.+?){_END}",
        rf"(?:informac(?:ao|oes)|dados?) (?:de|do|da|sobre) (?:o |a )?{_TEACHER}? ?(.+?){_END}",
    ]),
    ("disciplinas_termo", [
        rf"{_TERM} (\d+) {_DE} (.+?){_END}",
        rf"({_ORDINAL}) {_TERM} {_DE} (.+?){_END}",
    ]),
    ("eletivas_curso", [
        rf"eletivas? do grupo \d+ (?:de|do|da|para) (.+?){_END}",
        rf"funcionam? (?:as? )?(?:disciplinas? )?eletivas? (?:de|do|da|no|na) (.+?){_END}",
        rf"eletivas? (?:disponiveis? )?(?:para|no|na|do|da|de) (.+?){_END}",
    ]),
    ("trajectory_planning", [
        rf"{_DONE} (.+?)[,:] (?:como )?(?:chego|chegar|fica) (?:em )?([^.!?]+?)(?:[.!?]|$)",
        r"(?:fiz|concluis?) (.+?)[,.]? (?:como fica|o que falta) ?\??",
        rf"quero chegar em ([^,.!?]+?), (?:ja )?{_DONE} ([^.!?]+?)(?:[.!?]|$)",
        r"quero chegar em ([^,.!?]+?)(?:[,.!?]|$)",
        r"caminho (?:minimo )?para (?:chegar (?:em|ate) )?([^.!?]+?)(?:[.!?]|$)",
        r"como cheg(?:o|ar) (?:em|ate) ([^.!?]+?)(?:[.!?]|$)",
        r"sequencia (?:de disciplinas? )?para (?:cursar )?([^.!?]+?)(?:[.!?]|$)",
        r"planejamento para cursar ([^.!?]+?)(?:[.!?]|$)",
        r"(?:chegar? (?:em|ate)|ate) ([^.!?]+?)(?:[.!?]|$)",
    ]),
    ("matriz_info", [
        rf"(?:matriz|estrutura) (?:curricular )?(?:do curso )?{_DE} (.+?){_END}",
        rf"quantos? termos? (?:tem|possui|dura) (?:o )?(?:curso )?(?:de )?(.+?){_END}",
        rf"duracao (?:do curso )?{_DE} (.+?){_END}",
        rf"carga horaria (?:total )?{_DE} (.+?){_END}",
        rf"horas? (?:tem|precisa|possui) (?:o )?(?:curso )?(?:de )?(.+?){_END}",
        rf"fale (?:sobre )?(?:a )?(?:matriz )?{_DE} (.+?){_END}",
    ]),
    ("todos_termos_curso", [
        rf"disciplinas? (?:de |dos? )?(?:todos? )?(?:os )?termos? (?:da )?(?:matriz )?(?:curricular )?{_DE} (.+?){_END}",
        rf"disciplinas? (?:da matriz |da )?(?:por termo )?{_DE} (.+?){_END}",
        rf"grade (?:curricular )?(?:completa )?{_DE} (.+?){_END}",
    ]),
    ("coordenador_curso", [
        rf"coordena(?:dor(?:a)?|cao) {_DE} (.+?){_END}",
        rf"quem (?:e )?(?:o |a )?(?:vice[- ]?)?coordena(?:dor(?:a)?)?(?: {_DE})? (.+?){_END}",
    ]),
    ("listar_cursos", [
        rf"cursos? (?:disponiveis?|oferecidos?)(){_END}",
        rf"cursos? (?:que )?(?:a |o )?(?:universidade|faculdade|instituto) (?:oferece|tem|possui)(){_END}",
        rf"(?:liste|mostre|quero ver) (?:os? )?cursos?(){_END}",
    ]),
]
#: What a question surely asks for, tried in this order before anything else.
QUICK: Rules = [
    ("recommended_before", [r"(?:bom|legal|util|recomendad\w*|indicad\w*|vale a pena|ajuda(?:ria)?) (?:a )?(?:fazer|cursar|estudar|ter feito)? ?antes de\b"]),
    ("ementa_disciplina", [
        r"ementa\b", r"o que e ", r"o que (?:se )?(?:estuda|aprende) em\b", r"descreva ", r"explique? ", r"o que (?:voce )?sabe sobre\b",
        r"(?:fale|conte|conta|fala) sobre\b", r"o que ha sobre\b", r"carga horaria\b", r"bibliograf",
    ]),
    ("prerequisite_chain", [r"pre[- ]?requisitos?"]),
    ("dependents", [r"depend(?:e|em) de|desbloqueia"]),
    ("critical_disciplines", [
        r"disciplinas? criticas?", r"mais (?:importantes?|fundamentais?|essenciais?)", r"mais dependentes?", r"desbloqueiam mais", r"mais disciplinas? depend",
        r"maior numero de dependentes?", r"mais pre-?requisitos? (?:de outras?|para outras?)",
    ]),
    ("discipline_docentes", [
        r"quem (?:leciona|da|ensina)", rf"{_TEACHERS} (?:dao|que (?:leciona|dao|ensina|ministra))", r"(?:professor(?:es|a)?|docentes?) responsave(?:l|is) (?:por|pel[ao])",
        r"quem (?:e )?(?:o |a )?responsavel (?:por|pel[ao])",
    ]),
    ("docente_info", [rf"(?:email|e-mail|sala|contato) {_DE}"]),
    ("listar_cursos", [r"cursos? (?:da )?(?:universidade|faculdade|instituto)"]),
    ("eletivas_curso", [r"eletivas?"]),
    ("coordenador_curso", [r"coordena(?:dor|cao)"]),
    ("trajectory_planning", [
        r"caminho (?:minimo )?(?:para|ate)\b", r"como (?:chego|chegar) (?:em|ate)\b", r"sequencia (?:de disciplinas? )?para\b", r"planejamento para cursar\b",
        rf"{_DONE} .{{3,}}", r"quero chegar em\b",
    ]),
]
_FINAL = "[.!?]|$"
_OF_COURSE = "(?:a )?(?:disciplina (?:de )?)?"
#: What a question's term is once its intent is known, tried in this order; the last group that a pattern has holds it.
TERMS: dict[str, list[str]] = {
    "ementa_disciplina": [
        rf"o que e (?:o |a )?([a-z][a-z ]+?){_END}", rf"o que (?:se )?(?:estuda|aprende) em (.+?){_END}", rf"descreva a? ?disciplina (?:de )?(.+?){_END}", rf"do que trata (.+?){_END}",
        rf"ementa d[aeo] (.+?){_END}", rf"ementa (?:de )?([a-z][a-z ]+?){_END}", rf"(?:tem|ver|mostra) (?:a )?ementa (?:de )?(.+?){_END}",
        rf"o que (?:voce )?sabe sobre {_OF_COURSE}(.+?){_END}", rf"(?:me )?(?:fale|conte|conta|fala) sobre {_OF_COURSE}(.+?){_END}", rf"o que ha sobre {_OF_COURSE}(.+?){_END}",
        rf"carga horaria {_DE} (.+?){_END}", rf"bibliograf(?:ia)? {_DE} (.+?){_END}", rf"explique? {_OF_COURSE}(.+?){_END}",
    ],
    "recommended_before": [rf"antes de (?:fazer |cursar |estudar )?(.+?){_END}"],
    "prerequisite_chain": [
        rf"pre[- ]?requisitos? (?:de|da|do|para) (.+?){_END}", rf"antes de (?:fazer |cursar )?(.+?){_END}", rf"para (?:fazer|cursar) (.+?){_END}", r"^e (?:de|sobre) (.+?)(?:,|\?|$)",
        r"^e (?:de|sobre) (.+?)(?:,| quais?| os?|\?)",
    ],
    "dependents": [rf"depend(?:e|em) {_DE} (.+?){_END}", r"(?:usam?|precisam?|exigem?) (.+?) como", rf"(?:o que )?(.+?) desbloqueia{_END}"],
    "discipline_docentes": [
        rf"responsave(?:l|is) (?:por|pel[ao]) (?:a |o )?(?:disciplina (?:de )?|materia (?:de )?)?(.+?){_END}", rf"(?:leciona|ensina|ministra) (.+?){_END}", rf"da aula (?:de )?(.+?){_END}",
        rf"{_TEACHERS} (?:dao|de|da|do) (.+?){_END}", rf"dao (.+?){_END}", rf"aula de (.+?){_END}",
    ],
    "docente_disciplines": [rf"{_TEACHER} (.+?) (?:leciona|ensina)", r"(?:o |a )?(.+?) (?:leciona|ensina|da)"],
    "docente_info": [rf"(?:email|sala|contato) {_DE} (?:professor(?:a)? )?(.+?){_END}", rf"{_TEACHER} (.+?){_END}"],
    "docente_areas": [rf"areas? {_DE} (?:professor(?:a)? )?(.+?){_END}", r"(?:o |a )?(.+?) (?:pesquisa|trabalha|atua)"],
    "docentes_by_area": [rf"(?:trabalham?|pesquisam?|especialistas?) (?:com|em) (.+?){_END}", rf"{_TEACHERS} (?:de|em) (.+?){_END}"],
    "disciplinas_termo": [rf"{_TERM} (\d+) {_DE} (.+?){_END}"],
    "matriz_info": [rf"(?:curso|matriz) {_DE} (.+?){_END}", rf"{_DE} (.+?){_END}"],
    "eletivas_curso": [rf"eletivas? (?:de|do|da|para) (.+?){_END}"],
    "coordenador_curso": [rf"coordena(?:dor(?:a)?|cao) {_DE} (.+?){_END}", rf"coordena(?:dor(?:a)?) (.+?){_END}"],
    "todos_termos_curso": [rf"grade (?:de )?(.+?){_END}", rf"disciplinas? (?:do curso )?{_DE} (.+?){_END}"],
    "trajectory_planning": [
        rf"(?:ja )?(?:cursei|fiz|conclui) (.+?)[,:] (?:como )?(?:chego|chegar|fica) (?:em )?([^.!?]+?)(?:{_FINAL})", r"(?:ja )?(?:fiz|conclui) (.+?)[,.]? (?:como fica|o que falta) ?\??",
        rf"quero chegar em ([^,.!?]+?), (?:ja )?(?:fiz|cursei|conclui) ([^.!?]+?)(?:{_FINAL})", r"quero chegar em ([^,.!?]+?)(?:[,.!?]|$)",
        rf"caminho (?:minimo )?para (?:chegar (?:em|ate) )?([^.!?]+?)(?:{_FINAL})", rf"como cheg(?:o|ar) (?:em|ate) ([^.!?]+?)(?:{_FINAL})",
        rf"sequencia (?:de disciplinas? )?para (?:cursar )?([^.!?]+?)(?:{_FINAL})", rf"planejamento para cursar ([^.!?]+?)(?:{_FINAL})", rf"(?:chegar? (?:em|ate)|ate) ([^.!?]+?)(?:{_FINAL})",
    ],
}
#: Fixed value: a plan without a target.
NO_TARGET = r"(?:ja )?(?:fiz|conclui) (.+?)[,.]? (?:como fica|o que falta) ?\??"
#: Intents that the graph answers by itself.
DIRECT = """listar_cursos coordenador_curso disciplinas_termo todos_termos_curso eletivas_curso matriz_info prerequisite_chain dependents co_prerequisite critical_disciplines recommended_before
trajectory_planning discipline_docentes docente_leciona_disciplina docentes_by_area""".split()
#: The agents at which phrases on what a course is about (the third list of PHRASES) may still change the route; '' where none was chosen.
OPEN_AGENTS = ("", "docentes", "disciplinas")
#: Substrings that ask for a plan, whole words that show that it is another question, substrings that ask for news and for what the system can do, the most characters of the last.
PLAN = """montar grade|monta grade|monte grade|montar minha grade|monta minha grade|monte minha grade|montar a grade|monta a grade|monte a grade|planejar grade|planejar minha grade|planeje minha grade
plano de estudos|plano de estudo|planejamento de estudos|montar trajetoria|monte minha trajetoria|planejar trajetoria|planejar minha trajetoria|que materias devo cursar|quais materias devo cursar
que disciplinas devo cursar|quais disciplinas devo cursar|como me formar|para me formar|pra me formar|ordem das disciplinas|ordem das materias|que materias posso fazer|quais materias posso fazer
montar meu semestre|planejar meus semestres""".replace("\n", "|").split("|")
NO_PLAN = """quantas horas|quanto tempo|o que preciso|o que e preciso|o que eu preciso|oq preciso|oq eu preciso|que eu necessito|o que necessito|o que eu necessito|requisitos para|integralizar
integralizacao|formacao""".replace("\n", "|").split("|")
NEWS = """noticia|noticias|novidade|novidades|o que esta acontecendo|o que ta acontecendo|o que aconteceu|o que esta rolando|o que ta rolando|o que tem de novo|o que ha de novo|ultimas noticias
acontecendo no campus|eventos do campus|edital|editais|congresso academico|mural de noticias""".replace("\n", "|").split("|")
META, META_LENGTH = "voce tem acesso|tem acesso a|voce tem ementa|tem ementa|quais informacoes voce tem|o que voce sabe|o que voce consegue|voce consegue|quais dados voce|que tipo de informacao|do que voce dispoe".split("|"), 120
#: Questions on what something is, with its name.
OVERVIEW = [
    r"^o que e (?:o curso (?:de )?|o |a )?(.+?) ?\??$", r"^como (?:funciona|e) (?:o curso (?:de )?|o |a )?(.+?) ?\??$", r"^(?:me )?fale (?:mais )?sobre (?:o curso (?:de )?|o |a )?(.+?) ?\??$",
]
#: Words of a question that are never part of its term.
STOP_WORDS = """qual quais quem como onde quando que o a os as de da do em na no para por com sao e tem professor professora professores professoras docente docentes disciplina
materia curso leciona lecionam ensina ensinam da dao aula pre-requisitos requisitos ementa ementas ela ele elas eles dela dele delas deles isso esta este essa esse disso nessa
nesse""".split()
#: Phrases that settle the route, tried in this order, and the route of each intent.
PHRASES: Rules = [
    ("docentes", [
        "quais docentes", "quais professores", "quem leciona", "quem ensina", "quem ministra", "quem da aula", "que professor", "que professora", "professores de", "docentes de",
        "professores da", "docentes da", "professores do", "docentes do", "sobre o professor", "sobre a professora", "sobre o docente", "sobre a docente", "quem e o professor",
        "quem e a professora", "professor responsavel", "professora responsavel", "docente responsavel", "responsavel pela disciplina", "responsavel pela materia", "responsavel por",
        "costuma lecionar", "costuma ensinar", "disciplinas que ele", "disciplinas que ela", "disciplinas lecionadas por", "disciplinas ministradas por", "disciplinas do professor",
        "disciplinas da professora",
    ]),
    ("disciplinas", [
        "pre-requisito", "pre requisito", "prerequisito", "pre-reqs", "pre-req", "prereqs", "antes de cursar", "antes de fazer", "preciso cursar", "preciso de", "depende de", "dependem de",
    ]),
    ("disciplinas", [
        "fale mais sobre", "me fale mais", "me fale sobre", "fale sobre", "fale mais", "ementa", "o que sabe sobre", "o que vc sabe sobre", "o que e a disciplina", "descreva a disciplina",
        "conte mais sobre a disciplina",
    ]),
    ("regimentos", [
        "regimento", "regulamento", "norma", "artigo", "resolucao", "tcc i", "tcc ii", "tcc 1", "tcc 2", "ecos", "evacuacao", "incendio", "seguranca", "faq", "perguntas frequentes",
        "atividade complementar", "atividades complementares", "trancamento", "trancar", "aprovacao", "reprovacao", "indeferimento", "indeferida", "indeferido", "deferimento",
        "preenchimento de vagas", "prioridade na matricula", "criterios de matricula", "criterios de prioridade", "coeficiente de rendimento", "cr", "vagas em uc", "vagas na uc",
        "vagas de uma uc", "matricula em uc", "matricula em ucs", "inscricao em uc", "inscricao na uc", "inscricao em ucs", "inscricao em duas uc", "inscricao em duas ucs",
    ]),
    ("cursos", ["sequencial", "sequenciais", "certificado", "fundamentos de ciencia", "metodos estatisticos", "economia e mercados", "quimica aplicada", "desenvolvimento de games", "jogos digitais"]),
]
ROUTES = {
    "docentes": ["docente_info", "docente_areas", "docente_disciplines", "discipline_docentes", "docentes_by_area", "docente_leciona_disciplina"],
    "cursos": ["disciplinas_termo", "todos_termos_curso", "matriz_info", "eletivas_curso", "listar_cursos", "coordenador_curso"],
    "disciplinas": ["prerequisite_chain", "recommended_before", "dependents", "co_prerequisite", "critical_disciplines", "ementa_disciplina", "trajectory_planning"],
    "regimentos": ["artigos_sobre", "faqs"],
}
_AC = r"\bacs?\b|\batividades? complementar"
#: Requests, each with patterns of which one must be there and patterns of which none may be.
DETECTORS: dict[str, tuple[list[str], list[str]]] = {
    "progress": ([
        r"\bquanto (?:ainda )?falta\b.*\b(?:formar|integralizar|concluir|terminar)", r"\b(?:o que|oq) (?:ainda )?falta (?:cursar|fazer)\b",
        r"\bfalta (?:pra|para|p) (?:eu )?(?:me )?(?:formar|concluir|terminar)", r"\baudit\w*\b.*\b(?:situacao|progresso|curso)\b", r"\bmeu progresso\b",
        r"\bconsigo me formar\b", r"\b(?:devendo|pendencias?|pendente)\b.*\b(?:diploma|formar|formatura)\b", r"\bpegar (?:o |meu )?diploma\b",
    ], []),
    "enrolment": ([
        r"\b(?:posso|consigo) (?:me )?(?:matricular|inscrever|pegar|cursar|pedir)\b", r"\b(?:vao|vai|sera|serao) (?:deferir|deferida?s?|aceitar|indeferir)\b",
        r"\bminha inscricao (?:vai|sera)\b",
    ], [r"\ba qualquer momento\b", r"\bquando posso\b", r"\ba partir de (?:quando|que termo|qual termo)\b", r"\bem que (?:epoca|termo|semestre)\b", r"\bquais? (?:os )?requisitos\b"]),
    "requirements": ([
        r"\b(?:preciso|necessito) de quantas? horas\b", r"\bo ?que (?:eu )?(?:preciso|necessito) (?:para|pra) (?:me )?formar",
        r"quantas? horas.*\b(?:formar|integralizar|concluir|colar grau)", r"\b(?:carga horaria|horas)\b.*\b(?:para|pra|de) integraliza",
        r"\brequisitos? (?:de|para) (?:integralizacao|formatura|conclusao|se formar)", r"\bo que (?:o curso )?exige para (?:se )?formar",
    ], []),
    "gpa": ([
        r"\bmeu (?:cr|coeficiente)\b", r"\b(?:qual|quanto) (?:e|eh|esta|ta) (?:o )?(?:meu )?cr\b", r"\bcalcul\w+ (?:o )?(?:meu )?cr\b", r"\bsimul\w+ (?:o )?(?:meu )?cr\b",
        r"\bquanto (?:vai )?fica\w*\b.*\bcr\b", r"\bcr\b.*\bquanto (?:vai )?fica\w*\b", r"\bquanto preciso tirar\b", r"\bprevisao d[eo] cr\b",
    ], []),
    "activities": ([rf"\d+ ?h(?:oras?)?\b.*(?:{_AC})", rf"(?:{_AC}).*\d+ ?h(?:oras?)?\b", rf"\b(?:audit|simul|confer|verific|calcul|contabiliz|soma)\w*\b.*(?:{_AC})"], [r"\b(?:formar|integralizar)\b"]),
    "checklist": ([rf"\bchecklist\b.*(?:{_AC})", rf"(?:{_AC}).*\bchecklist\b", rf"(?:pronto|preparado) para (?:enviar|peticionar)\b.*(?:{_AC})"], []),
    "reset": ([
        r"\b(?:zera|zere|esquece|esqueca|apaga|apague|limpa|limpe)\b.*\b(?:atividades|horas|ac)\b", r"\brecomeca\w*\b.*\b(?:atividades|ac)\b",
        r"\bso (?:tenho )?(?:isso|essas?)\b.*\b(?:atividades|horas)\b",
    ], []),
    "track": ([
        r"\bquero trabalhar com\b", r"\bquero seguir (?:carreira|a area)\b", r"\bme especializar em\b", r"\btrilha (?:de|para|em)\b", r"\bquero aprender\b",
        r"\bque disciplinas (?:cursar|fazer) para\b", r"\b(?:meu )?sonho e (?:mexer|trabalhar|atuar)\b", r"\bmexer com\b", r"\bpor onde comeco\b", r"\batuar (?:com|na area de)\b",
    ], []),
    "risk": ([r"\bse (?:eu )?(?:reprovar|bombar|perder|nao passar) (?:em |a |o )?.+", r"\b(?:reprovar|bombar|nao passar) em .+? (?:o que|oq|atrasa|acontece)"], []),
    "offer": ([r"\b(?:vai ter|tera|vai abrir|vai rolar|vao ofertar|abre|e ofertad[ao]|sera ofertad[ao]|tem oferta|oferecem)\b.*\bsemestre", r"\bsemestre (?:e ofertad[ao]|tem|abre|oferecem|vai ter)\b", r"\bsemestre (?:par|impar) ?\?"], []),
    "interdisciplinary": ([r"\b(?:quais|que|lista de|liste as?)\b.*\binterdisciplinar", r"\binterdisciplinares (?:disponiveis|que (?:tem|existem))\b", r"\bintegradoras de conhecimento\b", r"\bquantas (?:ucs? )?interdisciplinares\b"], []),
    "greeting": ([r"^(?:oi|ola|eai|opa|alo|hey|hi|ei)[ ?!.,;:]*$", r"^(?:\S+ ){0,5}?(?:bom dia|boa tarde|boa noite|tudo bem|obrigad[oa]|valeu|tchau|ate logo)[?!.,;:]*(?: \S+){0,4}$"], [r"\b(?:qual|quais|quem|quando|onde|como|quanto|quantas?|o que|oq)\b", r"disciplina|materia|professor|docente|curso|requisito|ementa|matriz|termo"]),
}
#: Where lists begin and end in prose.
LISTS = {
    "completed": r"(?:cursei|conclui|terminei|fiz|ja cursei|ja fiz|tendo cursado|ja tenho) ?:? (.+?)(?:\. |\?|$)",
    "desired": r"(?:matricular(?:-me)? em|me inscrever em|inscricao em|vagas? em|pegar|pedir|cursar) ?:? (.+?)(?: (?:tendo|ja|se eu|sendo)\b|[.?] |[?.]$|$)",
    "current": r"(?:estou|esto|to|tou) (?:fazendo|cursando) (?:essas? disciplinas? ?:? )?(.+?)(?: (?:esse|este|neste|nesse|no) semestre)? ?(?:[.?!;]|$)",
}


def asked(c: Column | str) -> Column:
    return F.trim(text.text_key(c))


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.trim(c), r"[?.,!]+$", "")), r" (da|de|do|na|no|em)$", "")


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern).groups


def number_of(ordinal: Column) -> Column:
    """Digits of an ordinal in words; digits stay."""
    found = ordinal
    for n, start in enumerate(("prim", "segu", "terc", "quar", "quin", "sext", "seti", "oita", "non", "deci"), 1):
        found = F.when(ordinal.startswith(start), F.lit(str(n))).otherwise(found)
    return found


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def intent_and_term(c: Column | str, rules: Rules | None = None) -> Column:
    """struct(intent, term) of the first pattern that the question meets; null if none does. Terms of two parts are joined by a colon."""
    flat = [(name, p, _groups(p)) for name, patterns in rules or INTENTS for p in patterns]
    names, patterns, last = (F.array(*map(F.lit, column)) for column in zip(*flat, strict=True))

    def term(said: Column, rule: Column) -> Column:
        intent, pattern, groups = (F.element_at(x, rule) for x in (names, patterns, last))
        raw, two = F.call_function("regexp_extract", said, pattern, F.lit(1)), _clean(F.call_function("regexp_extract", said, pattern, groups))
        one = F.when(intent == "disciplinas_termo", number_of(F.trim(raw))).otherwise(_clean(raw))
        turned = (intent == "trajectory_planning") & said.startswith("quero chegar em")
        both = F.when(turned, F.concat_ws(":", two, one)).otherwise(F.concat_ws(":", one, two))
        return F.struct(intent.alias("intent"), F.when(groups < 2, _clean(raw)).otherwise(both).alias("term"))

    first = lambda said: F.coalesce(*(F.when(said.rlike(p), F.lit(k)) for k, (_, p, _) in enumerate(flat, 1)))
    return _let(asked(c), lambda said: _let(first(said), lambda rule: F.when(rule.isNotNull(), term(said, rule))))


def quick_intent(c: Column | str, rules: Rules | None = None) -> Column:
    said = asked(c)
    return F.coalesce(*(F.when(said.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in rules or QUICK))


def last_words(c: Column | str, n: int = 3) -> Column:
    """The last n words that are long and no stop-words: the term where no pattern yields one."""
    words = F.transform(F.split(asked(c), " "), lambda w: F.regexp_replace(w, r"[?!.,;:]+$", ""))
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.array_join(F.slice(kept, F.greatest(F.size(kept) - n + 1, F.lit(1)), n), " ")


def term_of(c: Column | str, intent: Column, terms: dict[str, list[str]] | None = None) -> Column:
    """The term of a question of a known intent: of the intent's first pattern that yields two characters or more, else the last words. Terms of two parts are joined by a colon."""
    said = asked(c)
    no_target = F.when(said.rlike(NO_TARGET), F.concat(F.regexp_replace(F.trim(F.regexp_extract(said, NO_TARGET, 1)), r"[?.,!]+$", ""), F.lit(":")))

    def found(name: str, pattern: str) -> Column:
        last = _groups(pattern)
        bare = [F.regexp_replace(F.trim(F.regexp_extract(said, pattern, k)), r"[?.,!]+$", "") for k in range(1, last + 1)]
        one = _clean(F.regexp_extract(said, pattern, last))
        if last == 2:
            one = F.concat_ws(":", *(reversed(bare) if name == "trajectory_planning" and pattern.startswith("quero chegar em") else bare))
        elif name == "trajectory_planning":
            one = F.coalesce(no_target, one)
        return F.when(said.rlike(pattern) & (F.length(one) >= 2), one)

    cases = F.coalesce(*(F.when(intent == name, F.coalesce(*(found(name, p) for p in patterns))) for name, patterns in (terms or TERMS).items()))
    return F.coalesce(cases, last_words(c))


def direct(intent: Column) -> Column:
    """Whether the graph answers an intent by itself."""
    return F.coalesce(intent.isin(*DIRECT), F.lit(False))


def _holds(said: Column, parts: list[str]) -> Column:
    return F.coalesce(*(F.when(F.contains(said, F.lit(p)), F.lit(True)) for p in parts), F.lit(False))


def kinds(c: Column | str, institution: str = "") -> Column:
    """Array of what a message asks for besides its intent: plan, news, meta. institution: its name in lower case without accents, by which news are asked for too."""
    said = asked(c)
    news = [*NEWS, *((f"acontecendo na {institution}", f"eventos da {institution}") if institution else ())]
    plan = _holds(said, PLAN) & ~text.phrase(said, *NO_PLAN)
    found = F.array(F.when(plan, F.lit("plan")), F.when(_holds(said, news), F.lit("news")), F.when(_holds(said, META) & (F.length(said) < META_LENGTH), F.lit("meta")))
    return F.filter(found, lambda x: x.isNotNull())


def overview_name(c: Column | str) -> Column:
    """The name in a question on what something is, of two characters or more; null in others."""
    said = asked(c)
    name = F.coalesce(*(F.nullif(F.regexp_replace(F.trim(F.regexp_extract(said, p, 1)), r"^[?.! ]+|[?.! ]+$", ""), F.lit("")) for p in OVERVIEW))
    return F.when(F.length(name) >= 2, name)


def overviews(rows: DataFrame, courses: DataFrame, programmes: DataFrame) -> DataFrame:
    """(id, name, programme): questions on what a programme is, whose name is no course's. rows: (id, text); courses, programmes: (name); programmes also by a part of their name, the least counts."""
    named = rows.select("id", overview_name("text").alias("name")).where("name IS NOT NULL").withColumn("key", text.graph_key("name"))
    free = named.join(courses.select(text.graph_key("name").alias("key")).distinct(), "key", "left_anti")
    keyed = programmes.select(F.col("name").alias("programme"), text.graph_key("name").alias("pk")).distinct()
    held = containing(free.select("key").distinct(), "key", keyed, "pk").groupBy("key").agg(F.min("programme").alias("programme"))
    return free.join(held, "key").select("id", "name", "programme")


def route(c: Column | str, intent: Column, phrases: Rules | None = None, routes: dict[str, list[str]] | None = None, current: Column | None = None) -> Column:
    """The agent of a question: by the first list one of whose phrases it holds as whole words, else by its intent, else the fallback.

    current: the agent that was chosen before, if any; unless it is one of OPEN_AGENTS the third list changes nothing.
    """
    said = asked(c)
    may = [F.lit(True) if current is None or k != 2 else F.coalesce(current, F.lit("")).isin(*OPEN_AGENTS) for k in range(len(phrases or PHRASES))]
    by_phrase = (F.when(ok & text.phrase(said, *words), F.lit(agent)) for ok, (agent, words) in zip(may, phrases or PHRASES, strict=True))
    by_intent = (F.when(intent.isin(*intents), F.lit(agent)) for agent, intents in (routes or ROUTES).items())
    return F.coalesce(*by_phrase, *by_intent, F.lit("fallback"))


def requests(c: Column | str, detectors: dict[str, tuple[list[str], list[str]]] | None = None) -> Column:
    """Array of the names of the requests that a text makes."""
    said = asked(c)
    met = lambda patterns: said.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
    found = F.array(*(F.when(met(some) & ~met(none), F.lit(name)) for name, (some, none) in (detectors or DETECTORS).items()))
    return F.filter(found, lambda x: x.isNotNull())


def listed(c: Column | str, kind: str) -> Column:
    """Array of the items of a list in prose, by what introduces it: completed, desired or current."""
    body = F.regexp_extract(asked(c), LISTS[kind], 1)
    if kind == "current":
        body = F.regexp_replace(body, r"\b(?:e )?(?:se eu|quanto|qual|quais|o que|oq|como)\b.*$", "")
    items = F.transform(F.split(body, ",| e |;"), lambda p: F.regexp_replace(p, r"^[ .?!]+|[ .?!]+$", ""))
    return F.filter(items, lambda p: F.length(p) >= (3 if kind == "current" else 1))


def supposed(c: Column | str) -> Column:
    """Array of (grade, course, credits): grades that a text supposes, as in 'tirar 8 em calculo de 4 creditos'."""
    pattern = r"(tirar \d+[.,]?\d* em (?:uma )?.+?(?: de \d+ creditos?)?(?:[.?,]|$))"
    parts = F.regexp_extract_all(asked(c), F.lit(pattern), 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            F.replace(F.regexp_extract(p, r"tirar (\d+[.,]?\d*)", 1), F.lit(","), F.lit(".")).cast("double").alias("grade"),
            F.regexp_extract(p, r"em (?:uma )?(.+?)(?: de \d+ creditos?)?[.?,]?$", 1).alias("course"),
            F.nullif(F.regexp_extract(p, r"de (\d+) creditos?", 1), F.lit("")).try_cast("int").alias("credits"),
        ),
    )


#: One grade supposed in all courses; signs that a mean is aimed at, and where it stands.
UNIFORM = r"(?:passar|tirar|fechar) (?:com |de )?(?:nota )?(\d+[.,]?\d*) em (?:todas|tudo|cada)"
AIMS = r"\b(?:preciso|necessari|quanto tenho que tirar)\b|\bcr\b.*\b(?:chegar|ficar|subir|bater)\b"
TARGETS = (r"(?:cr|coeficiente) ?(?:geral ?)?(?:chegar|ficar|ir|subir|bater) (?:a|em|para|pra|ate) (\d+[.,]?\d*)", r"(?:chegar|ficar|ir|subir|bater) (?:a|em|para|pra|ate) (?:cr )?(\d+[.,]\d+)")


def _number(found: Column) -> Column:
    return F.replace(F.nullif(found, F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def uniform_grade(c: Column | str) -> Column:
    """The grade that a text supposes in all courses; null in others."""
    return _number(F.regexp_extract(asked(c), UNIFORM, 1))


def target_mean(c: Column | str) -> Column:
    """The mean that a text aims at: the first that stands in it, if it says that it is aimed at; null in others."""
    said = asked(c)
    first, second = (F.regexp_extract(said, rf"^(?s)(.*?){p}", 2) for p in TARGETS)
    before = [F.length(F.regexp_extract(said, rf"^(?s)(.*?){p}", 1)) for p in TARGETS]
    earlier = F.when((first != "") & ((second == "") | (before[0] <= before[1])), first).otherwise(second)
    return F.when(said.rlike(AIMS), _number(earlier))

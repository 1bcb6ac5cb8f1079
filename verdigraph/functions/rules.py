"""Parameters of the text operators: word lists and wording. Every operator takes its rules as an argument, so other
languages and organisations bring their own."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# Portuguese stop words. Accented ones never match normalised tokens; results depend on that.
STOPWORDS = (
    "a ao aos aquela aqueles aquilo as até com como da das de dela dele deles depois do dos e ela elas ele eles em entre era essa essas "
    "esse esses esta estas este estes eu foi há já lhe mais mas me mesmo meu minha muito na nas nem no nos nós nossa nosso num numa o os ou "
    "para pela pelas pelo pelos por qual quando que quem se seja sem seu seus só sua suas também te tem temos ter um uma você vocês"
).split()
# Short tokens that stay, and what abbreviations stand for, in search, re-ranking and grounding.
ACRONYMS = "ia ai rh ti t1 t2 t3 t4 t5 sp rj nf cd pj pf".split()
SEARCH_SYNONYMS = {
    "ia": "ia inteligencia artificial",
    "ai": "ai ia inteligencia artificial",
    "rh": "rh recursos humanos gestao pessoas",
    "dpo": "dpo privacidade dados lgpd encarregado",
    "cdc": "cdc consumidor codigo",
    "sac": "sac atendimento suporte cliente",
    "nfe": "nfe nota fiscal",
    "sop": "sop procedimento operacional normas",
    "faq": "faq perguntas frequentes",
}
RERANK_SYNONYMS = {
    "ia": "ia inteligencia artificial",
    "ai": "ai ia inteligencia artificial",
    "rh": "rh recursos humanos",
    "dpo": "dpo privacidade dados lgpd",
    "cdc": "cdc consumidor codigo",
    "sac": "sac atendimento suporte",
}
GROUNDING_ACRONYMS = "ia ai rh ti t1 t2 t3 t4 t5 sp rj nf".split()
GROUNDING_SYNONYMS = {
    "ia": "ia inteligencia artificial",
    "ai": "ai ia inteligencia artificial",
    "rh": "rh recursos humanos",
    "dpo": "dpo privacidade dados lgpd",
    "6x1": "5x2 escala jornada trabalho turnos",
    "5x1": "5x2 escala jornada trabalho turnos",
    "regime": "escala jornada contratacao clt trabalho",
    "salario": "remuneracao beneficios pagamento salarios",
    "salarios": "remuneracao beneficios pagamento salario",
    "ferias": "descanso recesso rh",
}
# Words of small talk, which say nothing about a question.
CONVERSATIONAL = "bom dia boa tarde noite ola olá oi oie hey por favor gostaria saber pode dizer ajudar duvida duvidas dúvida dúvidas pergunta perguntas voce você sabe".split()
# Messages that are greetings and nothing else, in normalised spelling.
GREETINGS = (
    "bom dia|boa tarde|boa noite|ola|oi|oie|e ai|hey|hi|hello|tudo bem|ola tudo bem|oi tudo bem|bom dia tudo bem|boa tarde tudo bem|"
    "boa noite tudo bem|como vai|como voce esta|opa|salve|fala|ola assistente|ola bot"
).split("|")
# Greetings in front of a question.
OPENERS = "bom dia|boa tarde|boa noite|olá|ola|oi|oie|hey|por favor|gostaria de saber".split("|")


@dataclass(frozen=True)
class SearchRules:
    """Which tokens count in search, and what they expand to."""

    stopwords: tuple[str, ...] = tuple(STOPWORDS)
    acronyms: tuple[str, ...] = tuple(ACRONYMS)
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=lambda: {k: tuple(v.split()) for k, v in SEARCH_SYNONYMS.items()})


def confidence_threshold(value, default: float = 0.35) -> float:
    """A usable threshold in [0, 1]: default for null, NaN, infinite and unreadable values."""
    try:
        x = float(value)
    except (TypeError, ValueError):
        return default
    return min(1.0, max(0.0, x)) if math.isfinite(x) else default


# Words that switch the boost off and on.
_OFF = {"false", "0", "0.0", "no", "none", "off", "disable", "disabled", "nao", "não", "desativado"}
_ON = {"true", "1", "yes", "sim", "on", "enable", "enabled", "ativo", "ativado"}


def recency(boost=None, weight=None, default_boost: bool = False, default_weight: float = 0.15) -> tuple[bool, float]:
    """(enabled, weight) from what a caller may pass: flags, numbers or words. A number is a weight, too, unless
    another one is given; NaN and infinity switch the boost off."""

    def number(x: float) -> tuple[bool, object]:
        if not math.isfinite(x):
            return False, 0.0
        return x > 0, x if weight in (None, default_weight) else weight

    given = default_weight if weight is None else weight
    if boost is None:
        enabled, raw = default_boost, given
    elif isinstance(boost, bool):
        enabled, raw = boost, given
    elif isinstance(boost, str):
        word = boost.strip().lower()
        if word in _OFF or word in _ON:
            enabled, raw = word in _ON, given
        else:
            try:
                enabled, raw = number(float(word))
            except ValueError:
                enabled, raw = bool(word), given
    elif hasattr(boost, "__float__"):
        enabled, raw = number(float(boost))
    else:
        enabled, raw = bool(boost), given
    try:
        w = float(raw)
    except (TypeError, ValueError):
        return enabled, max(0.0, float(default_weight))
    return enabled, max(0.0, w) if math.isfinite(w) else 0.0

"""Word lists, tables and patterns. Results depend on them."""

STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "what", "when", "where", "which", "who", "with",
    "в", "во", "где", "и", "из", "какая", "какие", "каким", "каких", "какой", "как", "когда", "кто", "на", "о", "по", "сколько", "чем", "что", "это", "этот", "эта",
)
NOISE_TOKENS = (
    "в", "во", "и", "или", "на", "как", "какая", "какой", "какие", "каким", "что", "кто", "где", "когда", "сколько", "это", "этот", "эта",
    "был", "была", "были", "является", "называется", "используется", "официальный", "язык", "валюта", "столица",
)
#: Endings that the feature side cuts, longest first.
SUFFIXES_FEATURES = (
    "иями", "ями", "ами", "его", "ого", "ему", "ому", "ыми", "ими", "ий", "ый", "ой", "ая", "ое", "ее", "ые", "ие", "ых", "их", "ам", "ям", "ах", "ях", "ом", "ем", "ою", "ею",
    "ия", "ии", "ья", "ов", "ев", "а", "я", "ы", "и", "е", "у", "ю",
)
#: Endings that the data-building side cuts: another list, kept apart.
SUFFIXES_BUILDING = (
    "иями", "ями", "ами", "его", "ого", "ему", "ому", "ыми", "ими", "ий", "ый", "ой", "ая", "ое", "ее", "ые", "ие", "ых", "их", "ам", "ям", "ах", "ях", "ом", "ем",
    "ию", "ия", "ии", "ов", "ев", "а", "я", "ы", "и", "е", "у", "ю",
)
WHO = ("кто", "who")
WHEN = ("когда", "в каком году", "what year", "when")
WHEN_FEATURES = ("когда", "в каком году", "в каком", "when", "what year")
WHERE = ("где", "в какой стране", "в каком городе", "where")
COUNT = ("сколько", "how many", "how much")
FILLER = "ориентировочно"
ENTITY_SWAPS = {
    "Москва": "Санкт-Петербург", "Россия": "Казахстан", "Франция": "Италия", "Лондон": "Манчестер", "Афины": "Спарта", "Ньютон": "Эйнштейн", "Пушкин": "Лермонтов",
    "Италия": "Испания", "Париж": "Лион", "Фёдор Достоевский": "Лев Толстой", "Джордж Вашингтон": "Томас Джефферсон", "Нил": "Амазонка", "Юпитер": "Сатурн",
}
MONTH_SWAPS = {
    "января": "марта", "февраля": "апреля", "марта": "июня", "апреля": "июля", "мая": "августа", "июня": "сентября",
    "июля": "октября", "августа": "ноября", "сентября": "декабря", "октября": "января", "ноября": "февраля", "декабря": "мая",
}
NUMBER_WORD_SWAPS = {"один": "два", "два": "три", "три": "четыре", "пять": "шесть", "семь": "восемь", "десять": "двенадцать", "девяносто": "сто"}
SYMBOL_SWAPS = {"Au": "Ag", "H2O": "CO2", "DNA": "RNA"}
VARIANT_WEIGHTS = {
    "groq_negative": 1.6, "groq_drift_negative": 1.8, "groq_supported_positive": 1.1, "fever_refutes": 1.35, "popqa_negative": 1.15,
    "rule_negative": 0.9, "positive": 1.0, "popqa_positive": 1.0, "fever_supports": 1.0, "unknown": 1.0,
}
TEXT_FEATURES = ("answer_len_words", "prompt_overlap_ratio", "prompt_entity_coverage", "prompt_number_coverage", "answer_new_content_ratio", "answer_new_number_ratio", "question_type_mismatch")
AUDIT_FEATURES = ("h", "n", "e", "inv_r", "u", "c", "x", "inv_q", "inv_s", "m")
AUDIT_KEYS = ("h", "n", "e", "r", "u", "c", "x", "q", "s", "m")
PROFILES = ("generic", "who", "when", "where", "count")

#: A word character; Java's and RE2's own \w and \b differ from Unicode's.
WC = r"\p{L}\p{N}_"
WORD = rf"[{WC}](?:[{WC}\-]*[{WC}])?"
RUN = rf"[{WC}]+"
CAPITALISED = "[А-ЯЁA-Z][а-яёa-z]+"
SYMBOL = "[A-Z][A-Za-z0-9]{0,4}"
NUMBER = r"\d+(?:[.,]\d+)?"
YEAR = r"1[0-9]{3}|20[0-9]{2}|2100"
#: White space as str.split() has it, in a form that Java and RE2 share.
WS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def stem_pattern(suffixes: tuple[str, ...]) -> str:
    """Cuts the first listed ending that leaves four characters; as lists fall in length, a lazy stem finds it."""
    return f"^(.{{4,}}?)(?:{'|'.join(suffixes)})$"


def first(pattern: str) -> str:
    """(before, match, after) of the first whole-word match, without look-around: before is empty or ends, after is
    empty or begins with a non-word character."""
    return rf"(?s)^(|.*?[^{WC}])({pattern})([^{WC}].*|)$"

"""Closed vocabularies, label maps, thresholds and model registries."""

# Sentiments, in the order that decides ties; what stands for a text without a result, and for a skipped one.
SENTIMENTS = ["POSITIVE", "NEGATIVE", "NEUTRAL"]
UNKNOWN, SKIPPED = "UNK", "SKIPPED"
LANGUAGES = {"ar": "Arabic", "en": "English", "fr": "French"}

# Topics by language, in order; the last one is the fallback.
TOPICS = {
    "ar": ["السياسة", "الاقتصاد", "الأمن", "الطاقة", "النزاع", "الانتخابات", "العدالة", "الصحة", "الطقس", "الرياضة", "الثقافة", "التعليم", "التكنولوجيا", "البيئة", "الدبلوماسية", "الدين", "الهجرة", "عام"],
    "fr": ["Politique", "Économie", "Sécurité", "Énergie", "Conflit", "Élections", "Justice", "Santé", "Météo", "Sport", "Culture", "Éducation", "Technologie", "Environnement", "Diplomatie", "Religion", "Migration", "Général"],
    "en": ["Politics", "Economy", "Security", "Energy", "Conflict", "Elections", "Justice", "Health", "Weather", "Sports", "Culture", "Education", "Technology", "Environment", "Diplomacy", "Religion", "Migration", "General"],
}
FALLBACK_TOPIC = "General"
# The sentence that a zero-shot model completes with each topic.
TOPIC_SENTENCES = {"ar": "هذا المقال الإخباري يتحدث عن {}.", "fr": "Cet article de presse concerne {}.", "en": "This news article is about {}."}

# Words that speak for a negative text, words that open a question, and the limits of a short text.
NEGATIVE_CUES = {
    "ar": ["تقشف", "البطالة", "بطالة", "عقوبات", "انهيار", "ركود", "خسائر", "ضحايا", "كارثة"],
    "en": ["austerity", "unemployment", "sanctions", "collapse", "recession", "losses", "casualties", "victims", "disaster"],
    "fr": ["austérité", "chômage", "sanctions", "effondrement", "récession", "pertes", "victimes", "catastrophe"],
}
QUESTION_STARTERS = {
    "ar": ["من", "ما", "ماذا", "هل", "لماذا", "كيف", "أين", "متى", "أي", "كم"],
    "en": ["who", "what", "why", "how", "where", "when", "which", "is", "are", "do", "does", "did", "can", "could", "will", "would"],
    "fr": ["qui", "que", "quoi", "pourquoi", "comment", "où", "ou", "quand", "quel", "quelle", "quels", "quelles", "est-ce", "peut", "doit"],
}
SHORT_WORDS, SHORT_CHARS = 8, 60
SHORT_SCORE, CUE_SCORE = 0.6, 0.75

# Raw labels of sentiment models, by a part of the model's name; numbered labels stand for classes in order.
SENTIMENT_CLASSES = {
    "camelbert-mix-sentiment": ["POSITIVE", "NEGATIVE", "NEUTRAL"],
    "twitter-roberta-base-sentiment-latest": ["NEGATIVE", "NEUTRAL", "POSITIVE"],
    "distilcamembert-base-sentiment": ["NEGATIVE", "NEGATIVE", "NEUTRAL", "POSITIVE", "POSITIVE"],
}
STAR_MODEL = "distilcamembert-base-sentiment"
STAR_WORDS = [("1 STAR", "1 ÉTOILE"), ("2 STARS", "2 ÉTOILES"), ("3 STARS", "3 ÉTOILES"), ("4 STARS", "4 ÉTOILES"), ("5 STARS", "5 ÉTOILES")]
SENTIMENT_PARTS = [("pos", "POSITIVE"), ("neg", "NEGATIVE"), ("neu", "NEUTRAL"), ("mix", "NEUTRAL")]

# Entity types and the raw tags that mean them; those of the second list also come as B- and I- tags.
ENTITY_TAGS = {
    "PER": (["PER.", "PERS.", "HUMAN", "INDIVIDUAL", "PEOPLE", "PERSON NAME"], ["PER", "PERS", "PERSON", "PERSONS"]),
    "ORG": (["COMPANY", "INSTITUTION", "AGENCY", "UNIVERSITY", "MINISTRY", "GOV", "GOVERNMENT", "ORGANIZATION OR INSTITUTION OR GOVERNMENT BODY"], ["ORG", "ORGANIZATION", "ORGANISATION"]),
    "LOC": (["CITY", "COUNTRY", "REGION", "STATE", "PROVINCE", "GEOGRAPHIC LOCATION OR CITY OR COUNTRY"], ["LOC", "LOCATION", "GPE", "FAC", "FACILITY"]),
    "DAT": (["DAT", "TIM", "DATE OR TIME EXPRESSION"], ["DATE", "TIME", "DATETIME"]),
    "EVE": (["EVE", "NAMED EVENT OR ARMED CONFLICT OR POLITICAL CRISIS"], ["EVENT"]),
    "MIS": (["MIS", "MISCELLANEOUS", "OTHER", "OTH"], ["MISC"]),
    "PRO": (["PRO", "BRAND", "APP", "SOFTWARE", "PLATFORM", "COMMERCIAL PRODUCT OR BRAND NAME"], ["PRODUCT"]),
    "COM": (["COM", "LEAGUE", "TOURNAMENT", "CHAMPIONSHIP", "SPORTS COMPETITION OR LEAGUE OR TOURNAMENT"], ["COMPETITION"]),
}
#: Models with tags of their own, by a part of the name: four tags, bare or with B- or I-; the tag O is no entity.
MODELS_WITH_TAGS = ["arabert", "bert-base-ner", "camembert-ner"]
MODEL_TAGS = {"PER": "PER", "ORG": "ORG", "LOC": "LOC", "MISC": "MIS"}
NO_ENTITY = "O"
ZERO_SHOT_LABELS = [names[0][-1].lower() for kind, names in ENTITY_TAGS.items() if kind != "MIS"]

# Limits of entity extraction, chunks, and topics.
ENTITY_SCORE, MIN_PERSON, MIN_OTHER, EXPAND_UP_TO = 0.6, 2, 3, 3
CHUNK_TOKENS, TOKEN_OVERLAP, LEAST_TOKENS, TOPIC_CHUNK_CHARS = 450, 100, 16, 1500
LANGUAGE_SCORE = 0.51

# Numbers of models in result tables, and which entity models each language runs, in order.
MODEL_IDS = {
    "MostafaAhmed98/AraBert-Arabic-NER-CoNLLpp": 0, "dslim/bert-base-NER": 1, "Jean-Baptiste/camembert-ner": 2, "urchade/gliner_multi-v2.1": 3,
    "ar_sentiment_ft": 4, "en_sentiment_ft": 5, "fr_sentiment_ft": 6, "ar_topic_ft": 7, "en_topic_ft": 8, "fr_topic_ft": 9, "qwen2.5:7b": 10,
}
ENTITY_MODELS = {"ar": [0], "en": [1, 3], "fr": [2, 3]}


def entity_tags() -> dict[str, str]:
    """Raw tag -> entity type, tags in upper case."""
    plain = {tag: kind for kind, (own, _) in ENTITY_TAGS.items() for tag in own}
    return plain | {f"{mark}{tag}": kind for kind, (_, marked) in ENTITY_TAGS.items() for tag in marked for mark in ("", "B-", "I-")}


def model_tags(model: str) -> dict[str, str | None] | None:
    """The own tags of a model, or None if it has none; None as a type means no entity."""
    if not any(part in model.lower() for part in MODELS_WITH_TAGS):
        return None
    return {f"{mark}{tag}": kind for tag, kind in MODEL_TAGS.items() for mark in ("", "B-", "I-")} | {NO_ENTITY: None}


def chunk_tokens(model_limit: int, wanted: int = CHUNK_TOKENS) -> int:
    """Tokens of a chunk for a model that takes ``model_limit`` with its two marks."""
    return max(LEAST_TOKENS, min(model_limit - 2, wanted))

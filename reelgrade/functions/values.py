"""What must be equal for equal results. Nothing here is logic."""

CATEGORIES = ("violence", "sexual", "profanity", "alcohol_drugs", "scary")
SEVERITIES = ("None", "Mild", "Moderate", "Severe")
AGES = ("0+", "6+", "12+", "16+", "18+")

#: Upper bounds (exclusive) of the severities but the last.
SEVERITY_BOUNDS = (0.2, 0.4, 0.7)
SEVERITY_NUMBER = {"None": 0.0, "Mild": 0.33, "Moderate": 0.66, "Severe": 1.0}
UNKNOWN_SEVERITY_NUMBER = 0.66
SEVERITY_WORDS = {
    "none": "None", "mild": "Mild", "moderate": "Moderate", "severe": "Severe",
    "нет": "None", "лёгкое": "Mild", "легкое": "Mild", "среднее": "Moderate", "жёсткое": "Severe", "жесткое": "Severe",
}
SHORT_CATEGORIES = {"v": "violence", "p": "profanity", "s": "sexual", "a": "alcohol_drugs", "sc": "scary"}
LABEL_CATEGORIES = SHORT_CATEGORIES | {
    "насилие": "violence", "брань": "profanity", "секс": "sexual", "алкоголь": "alcohol_drugs", "страшное": "scary",
}
PLACE_TYPES = {
    "инт": "ИНТ.", "int": "INT.", "і": "ИНТ.", "ін": "ИНТ.", "нат": "НАТ.", "ext": "EXT.", "nat": "НАТ.", "и/н": "И/Н", "i/e": "I/E",
}
TIMES_OF_DAY = {
    "день": "ДЕНЬ", "day": "ДЕНЬ", "ночь": "НОЧЬ", "night": "НОЧЬ", "вечер": "ВЕЧЕР", "evening": "ВЕЧЕР", "утро": "УТРО", "morning": "УТРО",
}
ACTION_VERBS = ("входит", "выходит", "говорит", "смотрит", "берёт", "идёт", "садится", "стоит", "открывает", "закрывает")

#: Characters scored, kept around a hit, and kept of other texts.
SCORED_CHARS, HIT_CONTEXT, EPISODE_CONTEXT, LEGAL_CHARS = 8000, 25, 200, 240
EPISODE_CHARS, PREVIEW_CHARS, LOG_CHARS, ANNOTATION_CHARS, QUOTE_CHARS = 2000, 180, 120, 1200, 12
SCORE_SCALE = 0.25
PROBLEM_HITS = 5
FUSION = {"model": 0.55, "rule": 0.25, "episode": 0.20}
FUSION_WITHOUT_MODEL = {"rule": 0.80, "episode": 0.20}
SCENE_WINDOW, SCENE_STRIDE, TOP_WINDOWS = 384, 320, 3
EPISODE_WINDOW, EPISODE_STRIDE, EPISODE_WINDOWS, EPISODE_TOKENS = 256, 224, 16, 512

#: The lexicon that comes with the engine: word and weight, in order.
LEXICON = {
    "violence": (
        ("удар", 1.0), ("избил", 1.2), ("бьёт", 1.0), ("драка", 1.2), ("кровь", 1.6), ("ранен", 1.3), ("труп", 2.0), ("убил", 2.0),
        ("убийств", 2.0), ("нож", 1.5), ("клинок", 1.4), ("пистолет", 1.4), ("револьвер", 1.3), ("винтовк", 1.3), ("дробовик", 1.3),
        ("пулемёт", 1.4), ("автомат", 1.4), ("гранат", 1.5), ("взрыв", 1.5), ("перестрелк", 1.5),
    ),
    "sexual": (
        ("поцелу", 0.9), ("обним", 0.6), ("ласк", 0.9), ("интим", 1.0), ("эрот", 1.2), ("постель", 1.1), ("раздева", 1.0), ("голый", 1.0),
        ("оголён", 1.0), ("секс", 1.4), ("оргазм", 1.5), ("половой акт", 1.5),
    ),
    "profanity": (
        ("хуй", 2.0), ("еб", 2.0), ("пизд", 2.0), ("бля", 1.6), ("сук", 1.6), ("хер", 1.2), ("мраз", 1.4), ("гнид", 1.4), ("дерьм", 1.2),
        ("нахрен", 1.0), ("охрен", 0.8),
    ),
    "alcohol_drugs": (
        ("водк", 1.2), ("пив", 0.8), ("виск", 1.0), ("бух", 1.0), ("пьян", 1.0), ("похмел", 1.0), ("марихуан", 1.4), ("гандж", 1.4),
        ("шмаль", 1.4), ("гашиш", 1.5), ("героин", 1.8), ("кокаин", 1.8), ("амфетамин", 1.6), ("метамфетамин", 1.8), ("экстаз", 1.5),
        ("ЛСД", 1.5), ("косяк", 1.2), ("шприц", 1.2), ("«дать дорожку»", 1.2), ("нюхать", 1.0),
    ),
    "scary": (
        ("страшн", 1.0), ("жутк", 1.1), ("ужас", 1.1), ("пугает", 1.0), ("крик", 0.9), ("визг", 1.0), ("тень", 0.8), ("монстр", 1.1),
        ("призрак", 1.1), ("скример", 1.2), ("мертвец", 1.2), ("скелет", 0.9),
    ),
}

#: The older rating's words, looked for anywhere in a text.
PRESENCE_WORDS = {
    "violence": ("ударил", "кровь", "убил", "стреляет", "пистолет", "драка", "нож", "труп"),
    "sexual": ("поцеловал", "разделась", "постель", "эрот", "секс", "интим"),
    "profanity": ("черт", "блин", "сука", "гад", "дерьмо", "падла", "еб", "хер"),
    "alcohol_drugs": ("водка", "пьяный", "алкоголь", "наркотик", "косяк", "виски", "курит"),
    "scary": ("кричит", "труп", "монстр", "страшно", "крик", "кровь", "тень"),
}

#: Rule sets of the legal overrides in their order: reason, and patterns over lower-cased text (<b> is a word's border, <w> a word character).
OVERRIDES = (
    ("Обсценная лексика (436‑ФЗ)", ("<b>(еб[ао]н|пизд|хуй|охуенн|бляд)<w>*<b>", "<b>(нахуй|пидор|сука)<b>")),
    (
        "Наркотики: инструктивность/романтизация (436‑ФЗ)",
        (
            "<b>(как (приготовить|сделать|варить|закладк)|дозир<w>+|инструкц<w>+)<b>",
            "<b>(кайф|оргазм от|классно|без последств|ничего страшного)<b>",
        ),
    ),
    (
        "Натуралистическое насилие (436‑ФЗ)",
        ("<b>(натуралистическ<w>+|крупным планом|в деталях)<b>", "<b>(вскрыл|внутренност|кишк|кровищ)<w>*<b>"),
    ),
    ("Детализированное сексуальное описание (436‑ФЗ)", ("<b>(половой акт|вводит|фрикц<w>+|эякуляц<w>+|оральн<w>+)<b>",)),
)
OVERRIDE_AGE = "18+"

"""Parameters of the registered queries: the public tables are in Latin script, so the Russian defaults would hit nothing."""

from ..operators.models import Head

#: (category, ord, word, weight)
LEXICON = [
    ("violence", 0, "the", 1.2), ("violence", 1, "of", 0.8), ("sexual", 0, "de", 1.0), ("profanity", 0, "and", 1.6),
    ("alcohol_drugs", 0, "in", 1.0), ("scary", 0, "is", 0.9),
]
PRESENCE = {
    "violence": ("the", "thre", "ofth", "license"), "sexual": ("de", "ion", "token"), "profanity": ("and", "tion"),
    "alcohol_drugs": ("ing", "erat"), "scary": ("is", "was", "zu"),
}
#: Reason and patterns of ASCII words.
OVERRIDES = (
    ("license", ("<b>(license|licensed)<b>",)),
    ("secret", ("<b>(token|api_key|password)<b>", "<b>reserved<b>")),
    ("language", ("<b>(und|der|die)<b>",)),
)
#: Verbs that make a line of three words a scene.
VERBS = ("the", "de", "la", "und")


def head(width: int, shift: int) -> dict[str, Head]:
    """Fixed heads of a category."""
    w = [(((i * 7 + shift) % 11) - 5) / 10 for i in range(width)]
    u = [(((i * 3 + shift) % 7) - 3) / 10 for i in range(width)]
    return {"bin": Head("logistic", w, shift / 10), "sev": Head("ridge", u, 0.4)}

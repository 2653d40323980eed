"""Patterns of scene headings, put together from named fragments (Java's syntax, for use with the flags of ``text``)."""

# What counts as a heading.
LETTER = "[A-ZА-ЯЁ]"
NUMBERED = r"(?:\d+\s*-\s*\d+(?:\s*-\s*[A-Za-zА-ЯЁ])?)"
PERIOD = r"(?:\d{1,2}-[ЕE]\.?)"
TYPE = r"(?:ИНТ\.?|НАТ\.?|INT\.?|EXT\.?)"
TYPE_DOT = r"(?:ИНТ\.|НАТ\.|INT\.|EXT\.)"
TYPE_BOTH = r"(?:ИНТ\.?|НАТ\.?|INT\.?|EXT\.?|И/Н|I/E)"
DASH = "[-–—]"
T4 = "ДЕНЬ|НОЧЬ|ВЕЧЕР|УТРО"
T6 = f"{T4}|РЕЖИМ|РАССВЕТ"
T6_EN = f"{T4}|DAY|NIGHT"
T7 = f"{T6_EN}|РЕЖИМ"
T8 = f"{T7}|РАССВЕТ"
T8_EN = f"{T6_EN}|EVENING|MORNING"
T10 = f"{T8_EN}|РЕЖИМ|РАССВЕТ"
ORDINAL = r"(?:\s+\d+)?"
END_OF_WORD = r"(?![\p{L}\p{N}_])"
LEAD = rf"{NUMBERED}?\.?\s*"

#: The forms in which a line opens a scene.
OPENINGS = (
    rf"{LEAD}{PERIOD}?\s*{TYPE_BOTH}\s+[^\n]{{2,140}}?\s*{DASH}\s*(?:{T10}){ORDINAL}",
    rf"{LEAD}{TYPE}\s*[^\n]{{2,200}}?\.?\s+(?:{T8}){ORDINAL}\.?\s*$",
    rf"{LEAD}{TYPE}\s*{LETTER}+\.{LETTER}[^\n]{{1,100}}?\s+(?:{T6}){ORDINAL}",
    rf"\d+\.\s*{TYPE}\s+[^\n]{{2,120}}\s*{DASH}\s*(?:{T6}){ORDINAL}",
    r"(?:СЦЕНА|СЕРИЯ|ТИТРЫ)\s*\d*",
    rf"\d+\.\s*{TYPE}\s*[^\n]{{2,200}}?\.\s*(?:{T8}){END_OF_WORD}",
    rf"{LEAD}{TYPE}\s*{LETTER}[^\n.]{{2,100}}?\.{LETTER}[^\n]{{2,100}}?(?:\s*/\s*{LETTER}[^\n]{{2,100}}?)?",
    rf"{LEAD}{TYPE}\s*{LETTER}[^\n\s]{{4,120}}?(?:\s*/\s*{LETTER}[^\n]{{2,100}}?)?(?=\s*(?:ДЕНЬ|НОЧЬ|\n))",
    rf"\d+\.\s*{TYPE}\s*{LETTER}[^\n.]{{2,80}}?\.{LETTER}[^\n]{{2,80}}?(?:\s*\.\s*(?:{T6_EN}){END_OF_WORD})?",
)
#: The older diagnostic splitter's, and the headings that it counts.
OLDER_OPENINGS = (
    rf"{LEAD}{PERIOD}?\s*{TYPE_BOTH}?\s*[^\n]{{3,140}}?\s*[-–—:]\s*(?:{T8_EN}){END_OF_WORD}",
    rf"\d+\.\s*{TYPE}\s+[^\n]{{3,120}}\s*{DASH}\s*(?:{T6_EN}){END_OF_WORD}",
    rf"(?:\d+\s*-\s*\d+)?\.?\s*[иінінат]+\.?\s+[^\n]{{3,120}}\s*{DASH}\s*(?:день|ночь|вечер|утро){END_OF_WORD}",
    r"СЦЕНА\s+\d*",
)
COUNTED_HEADING = rf"^\s*(?:{LEAD}{PERIOD}?\s*{TYPE}\s*[^\n]{{3,140}}?\s*{DASH}\s*(?:{T6_EN}){END_OF_WORD})"


def splitter(openings=OPENINGS) -> str:
    return rf"(?=^\s*(?:{'|'.join(openings)}))"


#: Parsers of a heading: the pattern, and which of scene_no, period, place_type, location, tod its groups are.
NO, PER, TYP, LOC, TOD = "scene_no", "period", "place_type", "location", "tod"
PARSERS = (
    (rf"^\s*({NUMBERED})?\.?\s*({PERIOD})?\s*({TYPE})\s+([^-–—:\n]{{2,140}}?)\s*{DASH}\s*({T8}){ORDINAL}", (NO, PER, TYP, LOC, TOD)),
    (
        rf"^\s*({NUMBERED})?\.?\s*({PERIOD})?\s*({TYPE})\s+((?:{LETTER}[^\n]{{0,100}}?\.)?{LETTER}[^\n]{{1,100}}?)\s+({T8}){ORDINAL}\.?\s*$",
        (NO, PER, TYP, LOC, TOD),
    ),
    (
        rf"^\s*({NUMBERED})?\.?\s*({TYPE})\s+({LETTER}[^\s]{{2,40}}\.{LETTER}[^\s]{{2,80}}|{LETTER}[^\n]{{2,100}}?)\s+({T6}){ORDINAL}",
        (NO, TYP, LOC, TOD),
    ),
    (rf"^\s*(\d+)\.\s*({TYPE})?\s*([^-–—\n]{{2,120}}?)\s*{DASH}\s*({T7}){END_OF_WORD}", (NO, TYP, LOC, TOD)),
    (rf"^\s*(\d+)\.\s*({TYPE_DOT})\s*([^\n]{{2,200}}?)\.\s*({T8}){END_OF_WORD}", (NO, TYP, LOC, TOD)),
    # The class is the range from \n to the dash, less which nothing common is left; kept as it is.
    (rf"^\s*({LETTER}[^\n-–—]{{2,100}}?)\s*{DASH}\s*({T7}){END_OF_WORD}", (LOC, TOD)),
    (
        rf"^\s*(\d+(?:\s*-\s*\d+(?:\s*-\s*[A-Za-zА-ЯЁ])?)?)?\.?\s*({TYPE})\s*({LETTER}[^\n.]{{2,100}}?\.{LETTER}[^\n]{{2,100}}?)"
        rf"(?:\s*/\s*{LETTER}[^\n]{{2,100}}?)?",
        (NO, TYP, LOC),
    ),
    (
        rf"^\s*(\d+)\.\s*({TYPE})\s*({LETTER}[^\n.]{{2,60}}?\.){LETTER}[^\n]{{2,80}}?(?:\s*\.\s*({T8}){END_OF_WORD})?",
        (NO, TYP, LOC, TOD),
    ),
)
ANY_NUMBER = rf"<b>(\d+\s*-\s*\d+(?:\s*-\s*[A-Za-zА-ЯЁ])?|\d+)<b>"
ANY_TYPE = r"<b>(ИНТ\.?|НАТ\.?|INT\.?|EXT\.?|[иінат]+\.?)<b>"
ANY_TIME = rf"<b>({T6_EN})<b>"
ANY_TIME_WIDE = rf"<b>({T6_EN}|РЕЖИМ|РАССВЕТ|ЗАКАТ|СУМЕРКИ)(?:\s+\d+)?"

r"""Regular expressions, and their spelling for Spark's Java engine.

The patterns treat text as Unicode: `\d` is any decimal digit, `\w` any letter,
number or underscore, `\s` any space. Java gives the short forms an ASCII
meaning, so `unicode_classes` spells them out.
"""

# ---- Fixed values: what counts as a job, an address, a number -----------------
JOB_IN_FILENAME = r"application_ (.*?) from"
HEADER_BREAK = "\t\r\n"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
EMAIL_ENDINGS = (".com", ".net", ".fr")
PHONE = (
    r"(?<!\d)(?:\+?\d{1,3}[-.\s]?)?(?!2\d{3}[-.\s])(?:\(?[3-9]\d{1,3}\)?[-.\s]?)?"
    r"(?:\d{2,4}[-.\s]?){2,3}\d{2,4}(?!\d)"
)
POSTAL_ADDRESS = r"\d{1,5}\s+\w+(?:\s+\w+)*(?:,\s*\w+(?:\s+\w+)*)?,?\s*\d{5}"
# ------------------------------------------------------------------------------

SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
WORD_OR_SPACE = f"[{SPACE}{WORD}]"


def unicode_classes(pattern: str) -> str:
    return pattern.replace(r"\s", SPACE).replace(r"\w", WORD).replace(r"\d", DIGIT)


# A match of EMAIL can only begin where a run of address characters begins, or
# where the previous match ended. Saying so keeps the search linear on long
# unbroken runs (encoded attachments) without changing any match.
EMAIL_SEARCH = r"(?:\G|(?<![a-zA-Z0-9._%+-]))" + EMAIL

# A phone number opens with a plus sign, a bracket or a digit; the look-ahead
# lets the engine skip every other character at once.
PHONE_SEARCH = unicode_classes(r"(?=[+(\d])" + PHONE)

POSTCODE = DIGIT + "{5}"

# POSTAL_ADDRESS for very long texts. Two changes, neither affects a match:
# * words separated by spaces are one run of word and space characters with a
#   word character at both ends. Java walks such a run in a loop, while a
#   repeated group takes one stack frame per word and overflows.
# * if no address starts at the first house number of a run, none starts at a
#   later number of that run, since everything reachable from there is reachable
#   from the first. So each run is tried once, from its first number, which
#   keeps the search linear. Group 1 is the text before that number.
_RUN = rf"{WORD}(?:{WORD_OR_SPACE}*{WORD})?"
_HOUSE_NUMBER = rf"{DIGIT}{{1,5}}{SPACE}+"
ADDRESS_SEARCH = (
    rf"(?:\G|(?<!{WORD_OR_SPACE}))((?>{WORD_OR_SPACE}*?(?={_HOUSE_NUMBER}{WORD})))"
    rf"{_HOUSE_NUMBER}{_RUN}(?:,{SPACE}*{_RUN})?,?{SPACE}*{DIGIT}{{5}}"
)

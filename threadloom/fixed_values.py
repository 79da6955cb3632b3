"""Values that decide results and therefore may not be changed.

They are the tokens, word lists, patterns and defaults the cleaned text, the
packed rows and the losses are defined by.
"""

# --- fixed values: placeholder tokens -------------------------------------
URL_TOKEN = "<url>"
PHONE_TOKEN = "<phone> "  # written with a trailing space
USER_TOKEN = "<usr>"
BOT_TOKEN = "<bot>"
SIGNATURE_TOKEN = "<sig>"
END_OF_PIECES = ""  # paired with the last text piece of a turn

# Appended to the base vocabulary in this order, as ids V .. V+5.
PLACEHOLDERS = (
    URL_TOKEN,
    PHONE_TOKEN,
    USER_TOKEN,
    BOT_TOKEN,
    SIGNATURE_TOKEN,
    END_OF_PIECES,
)

# --- fixed values: patterns (Java syntax) ---------------------------------
# (?U) makes \b and \s Unicode-aware and (?d) makes \n the only line end.
# Word characters are spelled out: letters, numbers and the underscore,
# without the combining marks that (?U)\w would add.
URL_PATTERN = (
    r"(?Ud)(https?:\/\/(www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}"
    r"\.[a-zA-Z0-9()]{1,6}\b([-a-zA-Z0-9()@:%_\+.~#?&//=]*))"
)
PHONE_PATTERN = r"(?Ud)([+]*[(]{0,1}[0-9]{1,4}[)]{0,1}[-\s\./0-9]{7,15})"
USER_PATTERN = r"(?Ud)(@[0-9]{3,})"
SIGNATURE_PATTERNS = {
    "strict": r"(?d)([-/\^] *[A-Z]{1,2}[\p{L}\p{N}_]*)$",
    "loose": r"(?d)([-/\^]* *[A-Z]{1,2}[\p{L}\p{N}_]*)$",
}
DISALLOWED_PATTERN = r"""[^A-Za-z0-9/_$@ .!?'":\-#*\(\)<>\n&]"""
PLACEHOLDER_PATTERN = r"(<[\p{L}\p{N}_]+>)"

# --- fixed values: language gates -----------------------------------------
ENGLISH_SHARE = 0.4
SPANISH_WORDS = ("el", "de", "del", "que", "porque", "tu", "la", "pero", "mi", "en")

# --- fixed values: walk, packing, split and feed --------------------------
MAX_DEPTH = 20
SEQUENCE_LENGTH = 128
MAX_RESPONSE_IDS = 70
START_ID = 1
END_ID = 2
UNKNOWN_ID = 0  # also the padding id
MIN_WORDS = 2
TEST_RATE = 0.003
SPLIT_SEED = 1234
BATCH_SIZE = 32
LOG_EVERY = 50

# --- fixed values: vocabulary and vectors ---------------------------------
BASE_SPECIALS = ("<unk>", "<s>", "</s>")  # ids 0, 1 and 2
SUBWORD_VOCABULARY_SIZE = 8000
WORD_VECTOR_DIM = 512
TRIPLET_MARGIN = 0.5

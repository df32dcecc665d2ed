"""Texts and numbers that results depend on, stated as they are.

Every one of them is only the default of a keyword argument.
"""

# The two words whose presence selects the default corpus.
CORPUS_TERMS = ("shark", "sharks")

# The text columns searched for those words.
CORPUS_COLUMNS = ("title", "keyword", "keyword_plus", "abstract")

# Words added to the stop list.
EXTRA_STOP_WORDS = ("shark", "species")

# Whole words replaced after cleaning (plural to singular).
WORD_REPLACEMENTS = (("sharks", "shark"),)

# Texts containing one of these are dropped while cleaning.
DROP_CONTAINING = ("null",)

# Patterns used while cleaning, in order of use.
COPYRIGHT_TAIL = r"(?s)\(C\).+"
URL_TAIL = r"(?s) ?(f|ht)(tp)(s?)(://)(.*)[.|/](.*)"
NON_ASCII = r"[^\x01-\x7F]"
DIGITS = r"[0-9]+"
PUNCTUATION = r"""[\]\\?!"'$%&(){}+*/:;,._`|~\[<=>^\-]"""

# A word in running text, apostrophes and inner dots included.
WORD_PATTERN = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"

# Thresholds and sizes.
MIN_TERM_TF_IDF = 0.034
N_TOPICS = 19
MIN_GAMMA = 0.1
TOP_TERMS = 10
MIN_SIMILARITY = 0.5
MIN_KEYWORD_TF_IDF = 0.1
TOP_KEYWORDS = 20
MIN_CLUSTER_SIZE = 10

# Cluster value recoded in the people analysis.
CLUSTER_RECODE = {"28": "20"}

# Affiliation codes and the flag columns they become.
INSTITUTIONS = {
    "MCGILL-UNIV": "McGill",
    "UNIV-MONTREAL": "Montreal",
    "UNIV-TORONTO": "Toronto",
    "UNIV-BRITISH-COLUMBIA": "UBC",
    "UNIV-ALBERTA": "Alberta",
    "UNIV-OTTAWA": "Ottawa",
    "UNIV-WESTERN-ONTARIO": "Western",
    "DALHOUSIE-UNIV": "Dalhousie",
}

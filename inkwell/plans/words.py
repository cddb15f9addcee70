"""Words of the test tables, which are Latin, with the operators' own weights and limits."""

from __future__ import annotations

from inkwell.functions.lexicon import Relevance, Speech

LATIN = Relevance(((("tion", "ment", "heit", "ción"), 12), (("theat", "enau"), 18), (("the", "und", "les", "las"), 3), (("an", "er"), 1), (("###", "trash", "|"), -18)), ("###", "trash", "|"), ("ement", "heitä", "ther"))
LATIN_CATEGORIES = (("alpha", ("thea", "ieau")), ("beta", ("ver", "tion")), ("gamma", ("en",)))
LATIN_IMPORTANCE = (("top", ("ble", "heit")), ("high", ("ing", "aux")))
LATIN_KEYWORDS = ("the", "and", "of", "der", "und", "la", "les", "de", "que", "tion", "ing", "en")
LATIN_SPEECH = Speech(("licen", "instrum"), ("tion", "heit"), ("an", "le", "en"), ("the", "und", "les?", "que"), "aeiou", "A-Za-z", ".!?;")

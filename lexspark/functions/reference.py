"""Small fixed tables of the data model."""

# Part-of-speech tags and the category that the compiled lexicon files them under.
CATEGORY = {
    "verb": "Verb", "v": "Verb", "tr v": "Verb", "intr v": "Verb",
    "noun": "Noun", "n": "Noun", "m n": "Noun", "f n": "Noun",
    "masculine noun": "Noun", "feminine noun": "Noun", "neuter noun": "Noun",
    "adjective": "Adjective", "adj": "Adjective", "adverb": "Adverb", "adv": "Adverb",
    "preposition": "Preposition", "prep": "Preposition", "pronoun": "Pronoun", "pron": "Pronoun",
    "conjunction": "Conjunction", "conj": "Conjunction", "number": "Value", "num": "Value",
    "article": "Determiner", "art": "Determiner", "definite article": "Determiner", "indefinite article": "Determiner",
    "defin": "Determiner", "indefin": "Determiner", "modal": "Modal", "aux": "Auxiliary", "auxiliary": "Auxiliary",
}

# Endings of a tag and the word that a history file is named by.
HISTORY_POS = {
    "verb": "v|tr v|intr v|verb", "noun": "n|m n|f n|noun|masculine noun|feminine noun|neuter noun", "adjective": "adj|adjective",
    "adverb": "adv|adverb", "preposition": "prep|preposition", "pronoun": "pron|pronoun", "conjunction": "conj|conjunction",
    "number": "num|number", "article": "art|article|definite article|indefinite article|defin|indefin", "modal": "modal", "auxiliary": "aux|auxiliary",
}

#: Tags by full name, for reports.
POS_NAMES = {
    "v": "verb", "tr v": "transitive verb", "intr v": "intransitive verb", "n": "noun", "m n": "masculine noun", "f n": "feminine noun",
    "adj": "adjective", "adv": "adverb", "prep": "preposition", "pron": "pronoun", "conj": "conjunction", "num": "number",
    "art": "article", "defin": "definite article", "indefin": "indefinite article", "modal": "modal verb", "aux": "auxiliary verb",
}

#: Language tags by full name.
LANGUAGE_NAMES = {
    "ME": "Modern English", "MI": "Middle English", "OE": "Old English", "OF": "Old French", "FR": "French", "L": "Latin", "ON": "Old Norse",
    "DU": "Dutch", "MD": "Middle Dutch", "SP": "Spanish", "IT": "Italian", "RU": "Russian", "IR": "Irish", "GER": "German", "DA": "Danish",
    "CZ": "Czech", "AF": "Afrikaans", "SK": "Sanskrit", "AR": "Arabic", "ML": "Medieval Latin", "AG": "Ancient Greek",
}

# Keystrokes that change the character before them.
KEYS = {
    "A": {"A": "Â", "k": "Á", "`": "À"}, "a": {"a": "â", "k": "á", "`": "à"}, "C": {"x": "C̃"}, "c": {"w": "ç", "x": "c̃"}, "d": {"j": "d̦"},
    "E": {"E": "Ê", "k": "É"}, "e": {"e": "ê", "k": "é"}, "I": {"I": "Î", "k": "Í"}, "i": {"i": "î", "j": "ï", "k": "í"},
    "M": {"j": "M̃"}, "m": {"j": "m̃"}, "N": {"j": "Ñ"}, "n": {"j": "ñ"}, "O": {"O": "Ô", "k": "Ó", "`": "Ò"}, "o": {"o": "ô", "k": "ó", "`": "ò"},
    "S": {"x": "Ș"}, "s": {"x": "ș"}, "T": {"h": "Ћ"}, "t": {"j": "ț", "h": "þ"}, "U": {"U": "Û", "j": "Ü", "k": "Ú"},
    "u": {"u": "û", "j": "ü", "k": "ú"}, "w": {"a": "à", "e": "è", "i": "ï", "o": "ò", "u": "ü"},
}

# The vowel shift, (id, before, after, word, start x, start y, end x, end y).
VOWEL_SHIFT = [
    ("i", "/i:/", "/aɪ/", "bite", 10, 10, 40, 90), ("e", "/e:/", "/i:/", "meet", 15, 35, 10, 10), ("eps", "/ɛ:/", "/i:/", "meat", 20, 60, 10, 10),
    ("a", "/a:/", "/eɪ/", "mate", 25, 85, 15, 35), ("u", "/u:/", "/aʊ/", "out", 90, 10, 60, 90), ("o", "/o:/", "/u:/", "boot", 85, 35, 90, 10),
    ("open_o", "/ɔ:/", "/oʊ/", "boat", 80, 60, 85, 35),
]

#: Routes that show a widget, and prefixes of routes that show a grid.
ROUTE_WIDGETS = {"orthography/phenomena/great-vowel-shift": "vowel-shift"}
GRID_PREFIXES = ("dictionary",)

"""Small literal inputs that queries and tests share."""

from __future__ import annotations

#: (file, text) of entry files: one for each branch of the parser and the classifier, and for each lint rule.
FILES = [
    ("b/body.txt", "bodig [OE]\nbodi [MI]\nbody [ME]\nbody bodie -is (adj, m n)\nhttps://www.etymonline.com/word/body"),
    ("f/fox.txt", "fox [OE]\nfox -es (m n)\nhttps://www.etymonline.com/word/fox\nhttp://example.org/fox"),
    ("c/claw.txt", "to claw [ME]\nto claue -s -d -ing (v)"),
    ("s/see.txt", "see [ME]\nto sihe -s sau sine -ing (v)"),
    ("w/work.txt", "to work [ME]\nto uirche uirc(s -d -ing (v)"),
    ("f/fare.txt", "faran [OE]\nto fare [ME]\nfere fere(s foer faren fering (v)"),
    ("w/will.txt", "will, would, won't, wouldn't [ME]\nuill, oûd, uon't, oûdn't (modal, aux)"),
    ("c/can.txt", "can, could, can't [ME]\ncan, coûd, cânt (modal)"),
    ("w/would.txt", "would [ME]\noûd, oûds (modal)"),
    ("b/be.txt", "be [ME]\nbie am is are uas uere bign (v)"),
    ("b/am.txt", "be, am [MI]\nbie am (v)"),
    ("s/seer.txt", "seer [ME]\nsiher sihor -s (m n)"),
    ("a/alternate.txt", "alternate [ME]\nalternat -s -ly (adj, m n)"),
    ("h/hammer.txt", "hammer [ME]\nhamere hamirs (m n)"),
    ("q/quick.txt", "cwic [OE]\nquick\nquic -ly (adj)"),
    ("f/foo.txt", "foo [OE]\n\nbar [ME]\nbarre (n)\n\n\nto claue -s -d -ing"),
    ("t/two.txt", "two [ME]\none -s (n)\ntou -s (n)"),
    ("r/return.txt", "return [ME]\r\nretoúrn -s -ed -ing (v)\r\n"),
    ("e/escape.txt", "es\"ca\\pe [OE]\nes\tcape [ME]\nescâpe -s (n)\nhttp://a.b/\"x\\y"),
    ("w/white.txt", "white [ME]\nhuite (adj)\n \t\nblack [ME]\nblac (adj)"),
    ("a/a.txt", "an [OE]\na, an [ME]\na (indef)"),
    ("l/lone.txt", "lonn (n)"),
    ("e/empty.txt", ""),
    ("n/nopos.txt", "broken [ME]\nbroken word\nhttp://x.y/z"),
    ("n/nolang.txt", "broken word\nbrocn (adj)\nhttp://x.y/z"),
    ("t/trailing.txt", "trailing [ME] \ntrâling (v)"),
    ("u/unknown.txt", "foo [ME]\nfou, fous (mn)"),
    ("t/tiger.txt", "tiger [ME]\nti\u0302gre ti\u0302gars (m n)"),
    ("m/mixed.txt", "mixed [ME] (adj)\nmixt (adj)"),
]

#: (eng, category, form, present, third_singular, past, participle, gerund, plural, ord): a lexicon for translation.
BRAIN = [
    ("she", "Pronoun", "sie", None, None, None, None, None, None, 1),
    ("make", "Verb", "mâche", "", "-s", "mâde", "", "-ing", None, 2),
    ("the", "Determiner", "þe", None, None, None, None, None, None, 3),
    ("cake", "Noun", "câc", None, None, None, None, None, "caix", 4),
    ("circle", "Verb", "circle", "", "-s", "-d", "", "-ing", None, 5),
    ("circle", "Noun", "circle", None, None, None, None, None, "circuls", 6),
    ("quick", "Noun", "quic", None, None, None, None, None, "-s", 7),
    ("fox", "Noun", "fox", None, None, None, None, None, None, 8),
    ("jump", "Verb", "gimpe", "", "", "-d", "", "", None, 9),
    ("and", "Conjunction", "ant", None, None, None, None, None, None, 10),
    ("of", "Preposition", "ov", None, None, None, None, None, None, 11),
    ("in", "Preposition", "inn", None, None, None, None, None, None, 12),
    ("is", "Verb", "is", None, None, None, None, None, None, 13),
    ("that", "Determiner", "þat", None, None, None, None, None, None, 14),
    ("to", "Preposition", "tou", None, None, None, None, None, None, 15),
    ("on", "Adverb", "onn", None, None, None, None, None, None, 16),
    ("thing", "Noun", "þingue", None, None, None, None, None, "-s", 17),
    ("wait", "Verb", "uâtie", "", "-is", "", "", "", None, 18),
]

#: (form, root, gerund) cases of the morphology.
FORMS = [
    (None, "test", False), ("did", "do", False), ("(went)", "go", False), ("-s", "book", False), ("-ly", "sad", False), ("-ed", "translate", False),
    ("-ing", "make", False), ("-s", "cyngue", False), ("-s", "mâche", False), ("-s", "make", False), ("-ment", "state", False), ("-ing", "bie", True),
    ("-ing", "mâche", True), ("-is", "comittie", False), ("-s", "", False), ("", "go", False), ("-d", "see", False), ("-ies", "fly", False),
]

#: (original, replacement) cases of the casing.
CASES = [
    ("hello", "hialo"), ("Hello", "hialo"), ("HELLO", "hialo"), ("The", "þe"), ("THE", "þe"), ("Hello,", "hialo"), ('"HELLO"', "hialo"), ("[hello]", "hialo"),
    ("A", "an"), ("123", "x"), ("", "x"), ("x", ""), ("iPhone", "fone"),
]

#: Keystrokes and the text that they make.
TYPED = [("o,o", "ô"), ("t,h", "þ"), ("T,h", "Ћ"), ("o,o,o", "ôo"), ("c,x", "c̃"), ("t,j", "ț"), ("a,b", "ab"), ("a,Backspace,a", "â"), ("Shift,T,h,e", "Ћe")]

#: (name, paths) of drawings.
PATHS = [("triangle", ["M 0 0 L 10 0 L 10 10 Z"]), ("none", []), ("two", ["M 5 5 L 7 9", "M -3 2 Q 4 4 8 1"]), ("arc", ["M 100 100 A 50 50 0 0 1 200 100"]), ("curve", ["M 300 300 C 310 320 330 340 350 300 Z"])]

#: (name, text) for normalisation: composed, decomposed, without a composed form.
UNICODE = [("plain", "abc"), ("decomposed", "tîgre"), ("cedilla", "poș"), ("none", "c̃"), ("composed", "tîgre")]


def literal(value) -> str:
    """A value as an SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows, name: str, columns: str) -> str:
    """``name(columns) AS (VALUES ...)`` for a WITH clause."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows) + ")"

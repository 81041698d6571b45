"""The keyboard as a fold over keystrokes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .reference import KEYS

#: Keys that change nothing, and those that only end a pending change.
IGNORED = ("Shift", "Control", "Alt", "Meta", "CapsLock", "Tab", "Escape", "ArrowLeft", "ArrowRight", "ArrowUp", "ArrowDown")
ENDING = ("Backspace", "Delete")


def typed(keys: Column, table: dict[str, dict[str, str]] | None = None) -> Column:
    """The text that an array of keystrokes makes: a key may change the character before it, and so on."""
    pairs = {a + b: out for a, row in (table or KEYS).items() for b, out in row.items()}
    known = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])

    def press(text: Column, key: Column) -> Column:
        change = F.try_element_at(known, F.concat(F.right(text, F.lit(1)), key))
        made = F.when(change.isNotNull(), F.concat(F.substr(text, F.lit(1), F.length(text) - 1), change)).otherwise(F.concat(text, key))
        return F.when(key.isin(*IGNORED, *ENDING), text).otherwise(made)

    return F.aggregate(keys, F.lit(""), press)

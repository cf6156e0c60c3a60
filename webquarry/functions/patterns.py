"""Regular expressions shared by several operators.

Patterns avoid lookaround and back references, so that they can also be run by an RE2
engine when results are cross-checked; WS has a plain twin for that.
"""

# White space as JavaScript sees it; Java's own \s is ASCII only.  WS is the same set as
# PLAIN_WS, nested so that a plain letter is refused after two comparisons.
PLAIN_WS = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
WS = (
    r"[\t\n\x0B\f\r \x{00A0}[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}]]]"
)
WS_RUN = WS + "+"
WS_CHARS = "\t\n\x0b\f\r   " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
PLAIN_WS_RUN = PLAIN_WS + "+"
EDGE_WS = rf"\A{PLAIN_WS}+|{PLAIN_WS}+\z"
NON_WS = "[^" + PLAIN_WS[1:-1] + "]+"

SCRIPT_STYLE = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
COMMENT = r"(?s)<!--.*?-->"
HIDDEN = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"

# A tag may hold '>' inside a quoted value; a lone '<' is text.  Possessive repeats are matched by a loop: a group that
# may back off is matched by recursion, and a page with a missing quote then overflows the stack.  The pieces start
# with different characters, so backing off could find nothing more.
INSIDE_TAG = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+"""
TAG = rf"<[a-zA-Z/!?]{INSIDE_TAG}>"
TOKEN = rf"(?s){TAG}|[^<]+|<"
TAG_NAME = r"^</?([a-zA-Z][a-zA-Z0-9]*)"


def attr_pattern(name: str) -> str:
    """Value of one attribute of a tag token, with its quotes, in group 1."""
    return rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def attr_present(name: str) -> str:
    return rf"""(?is)[\s"']{name}(?:[\s=>/]|\z)"""

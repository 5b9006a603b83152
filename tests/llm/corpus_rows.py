"""Rows with all odd cases for the tests of the operators."""

import re

WHITE = re.compile("[\x20\x09-\x0D]")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

# One row a case: nulls, empty and blank texts, ties, copies, few words, marks, other scripts, a long text.
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(6000))
BASE = " ".join(f"alpha{i}" for i in range(40))
TEXTS = [
    None, "", "   \n\t ", "one", "One two", "one TWO", "a b c d e", "A B C D E", BASE, BASE, BASE + " more", BASE.upper(),
    "x y\nz", "xy z", "xyz", LONG, LONG + " end", "line one is here\nline two is here\nline three is here\nunique tail A",
    "start B\nline one is here\nline two is here\nline three is here\ntail B", "it's <|endoftext|> naïve ΑΣ 日本 ½ 🙂",
    "mail bob.x@mail.example.com or 10.0.0.300 and 10.0.0.1 card 4111 1111 1111 1111 call +1 (212) 555-0100 now",
    "!!! *** $$$ ||| !!!", "\n\n\n\n", "same\nsame\nsame\nsame\nsame"]


def rows():
    out = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"src{i % 2}", None if t is None else len(t))
           for i, t in enumerate(TEXTS)]
    out.append((None, "a row without an id", None, None, None))
    out.append((8, BASE, "en", "src0", len(BASE)))              # a repeated row
    return out

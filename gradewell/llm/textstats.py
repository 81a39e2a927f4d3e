"""Statistics of a text that the quality operators learn from."""

from __future__ import annotations

# What separates words, and what counts as a symbol.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Statistics by which documents are judged; ratios, so a text's length does not decide.
JUDGED = ["symbol_share", "bang_share", "upper_share", "distinct_share", "chars_per_word", "dup_line_share"]


def words_of(text: str) -> list[bytes]:
    """Words as UTF-8; ``bytes.split`` cuts at exactly the characters of BLANKS."""
    return text.encode("utf-8", "surrogatepass").split()


def line_counts(text: str) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    seen, lines = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            seen.add(line)
    return lines, lines - len(seen)


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words found twice or more in the text."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[i:] for i in range(size))))
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    if not twice:
        return 0
    total = end = 0
    for i, w in enumerate(windows):
        if w in twice:
            total += i + size - max(i, end)
            end = i + size
    return total


def counts(text: str, words: list[bytes]) -> dict:
    n_words = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    lines, dup = line_counts(text)
    symbols = sum(map(text.count, SYMBOLS))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    most, per_word = max(chars, 1), max(n_words, 1)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup,
            "symbol_share": symbols / most, "bang_share": text.count("!") / most,
            "upper_share": upper / most, "distinct_share": len(set(words)) / per_word,
            "chars_per_word": chars / per_word, "dup_line_share": dup / max(lines, 1)}

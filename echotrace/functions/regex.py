"""One table of regular expressions with two spellings: Java (Spark) and RE2
(the DuckDB oracle).

Python's ``\\w \\s \\d`` are Unicode classes; Java's are ASCII unless ``(?U)``
and then differ again (Java's ``\\w`` also takes combining marks), RE2's are
ASCII.  Every class is therefore spelled out as the *same character set* in
both engines: Java uses the fast ``\\p{IsWhite_Space}`` property, RE2 lists the
same code points.  Only patterns that need look-around are Java-only; the
oracle spells those with anchored extraction.
"""

from __future__ import annotations

from dataclasses import dataclass

# Python str.isspace() characters = Unicode White_Space plus the four
# information separators U+001C..U+001F.
WS_STRING = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
             + "".join(chr(c) for c in range(0x2000, 0x200B))
             + "\u2028\u2029\u202f\u205f\u3000")


@dataclass(frozen=True)
class Flavor:
    ws_chars: str          # body of a character class matching Python whitespace

    @property
    def ws(self) -> str:
        return "[" + self.ws_chars + "]"

    @property
    def word(self) -> str:
        """Python's ``\\w``: letters, numbers, underscore (no combining marks)."""
        return r"[\p{L}\p{N}_]"

    @property
    def not_word_not_ws(self) -> str:
        return r"[^\p{L}\p{N}_" + self.ws_chars + "]"

    @property
    def digit(self) -> str:
        return r"\p{Nd}"

    @property
    def non_ws(self) -> str:
        return "[^" + self.ws_chars + "]"

    def clean_text_steps(self) -> list[tuple[str, str]]:
        d, ws = self.digit, self.ws
        # The ordered removal steps of the post/article text
        # cleaner; they must equal the reference's list for identical results.
        return [
            ("Video Player", ""),
            (r"Video 태그를 지원하지 않는 브라우저입니다\.", ""),
            (d + "{2}:" + d + "{2}", ""),
            (r"[01]\." + d + "{2}x", ""),
            ("출처:" + ws + r"?[^\n]+", ""),
            ("/" + ws + "?" + d + r"+\.?" + d + "*", ""),
            ("[ㅋㅎㅠㅜ]+", ""),
            (r"[!?~.,\-#]{2,}", ""),
            ("&[a-z]+;|&#" + d + "+;", ""),
        ]


JAVA = Flavor(ws_chars=r"\p{IsWhite_Space}\x{1c}-\x{1f}")
RE2 = Flavor(ws_chars=(r"\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                       r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"))

# For each step of the cleaner texts of which every match holds one; none: the step runs on every text.
CLEAN_TEXT_SIGNS = [("Video Player",), ("Video 태그를",), (":",), ("0.", "1."), ("출처:",), ("/",), ("ㅋ", "ㅎ", "ㅠ", "ㅜ"), (), ("&",)]

# The last class of the cleaner is a character *set*: backslash, NBSP, ZWSP,
# ideographic space, ZWNJ and the single letters _ x 0 D.
CLEAN_TEXT_CHARSET = r"[\\\x{a0}\x{200b}\x{3000}\x{200c}_x0D]"
# Evident intent of the same step: the five characters and the token _x000D_.
CLEAN_TEXT_TOKENS = r"\\|\x{a0}|\x{200b}|\x{3000}|\x{200c}|_x000D_"

# Java-only (look-around).  Sentence boundary of the first/last sentence:
# after . ! ? and before whitespace or a Hangul syllable (zero width).
SENTENCE_BOUNDARY = r"(?<=[.!?])(?=" + JAVA.ws + "|[가-힣])"
# Sentence boundary of the copy-ratio splitter: . ! ? then whitespace.
SENTENCE_GAP = r"(?<=[.!?])" + JAVA.ws + "+"
PARAGRAPH_GAP = r"\n{2,}"

# Back-compatible names (Java spelling) used by the Column functions.
WS = JAVA.ws
WS_CHARS = JAVA.ws_chars
WORD = JAVA.word
NOT_WORD_NOT_WS = JAVA.not_word_not_ws
DIGIT = JAVA.digit
CLEAN_TEXT_STEPS = JAVA.clean_text_steps()

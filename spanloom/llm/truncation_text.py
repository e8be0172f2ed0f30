"""Patterns of the truncation operator, in Java's regular expressions."""

#: Words with their marks (those of ASCII first); signs; single signs of scripts without blanks; line ends; a blank between Thai letters.
TOKEN = (
    r"[a-z']++(?![^\x00-\x7f])|[!-`{-~&&[^a-z']]|(?:[a-z']|[\p{L}\p{M}’&&[^ก-๎぀-ヿ㐀-鿿]])++|[ก-๎぀-ヿ㐀-鿿]|\s*\n\s*"
    r"|(?<=[ก-๎]) +(?=[ก-๎])|[^\s\p{L}\p{M}]"
)

#: A sentence mark with its closing marks at the end; a full stop is not sure to end a sentence ('i.e.').
SENTENCE_END = r"(?:[!?。！？।॥؟۔][\"'’”»“」』）)\]】》*_`\s]*|[.][\"'’”»“」』）)\]】》*_`\s]*[\"'’”»“」』）)\]】》*_`])\z"

#: Marks that a cut leaves.
CUT_MARK = (
    r"(?i)(?:…|\.\.\.|\[(?:\.\.\.|…)\]|\((?:\.\.\.|…)\)|�|[\[<(](?:truncated|cut off|cut|output truncated|max(?:imum)? (?:length|tokens)[^\]>)]*|length limit[^\]>)]*|continued?|to be continued|"
    r"text truncated|response truncated|snip)[\]>)])[\"'”»\s]*\z"
)

#: A last line that is nothing but a label: an empty answer, not a cut one.
LABEL_ONLY = r"(?U)^\s*[*_#> ]*[\p{L}\p{M} ]{1,24}[*_]*\s*[:：][*_ ]*$"

#: Ends of a stated answer.
ANSWER_END = r"(?:\\boxed\{[^{}\n]*\}[$.]*|\*\*[^*\n]{1,40}\*\*|</answer>|\\\]|```)\s*\z"

#: A value of one short word or number: a bare answer.
BARE = r"(?U)\A\s*\S{1,12}\z"

#: White space and invisible characters at the end of a value.
BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u200b\u200c\u200d\u2028\u2029\u3000\ufeff"

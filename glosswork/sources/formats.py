"""Document formats: markup into blanks (deformat) and back (reformat).

A format is a list of rules: tags, comments (kept whole as blanks) and replacements, with the
characters that count as space and those that are escaped. At each place the longest match holds,
then the rule of the lowest priority number, then the one that comes first.
"""

from __future__ import annotations

import html.entities
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field

HEADING = "\u2761"


@dataclass(frozen=True)
class Rule:
    begin: re.Pattern
    end: re.Pattern | None = None  # of a comment
    eos: bool = False
    eoh: bool = False
    priority: int = 3


def tag(pattern: str, eos: bool = False, eoh: bool = False, priority: int = 3) -> Rule:
    return Rule(re.compile(pattern, re.IGNORECASE | re.DOTALL), None, eos, eoh, priority)


def comment(begin: str, end: str, eos: bool = False, priority: int = 2) -> Rule:
    return Rule(re.compile(begin, re.IGNORECASE | re.DOTALL), re.compile(end, re.IGNORECASE | re.DOTALL), eos, False, priority)


def _any(patterns: Iterable[re.Pattern]) -> re.Pattern:
    """Wherever one of the patterns begins, each with its own flags."""
    flags = ((re.IGNORECASE, "i"), (re.DOTALL, "s"), (re.MULTILINE, "m"), (re.VERBOSE, "x"))
    named = [(p.pattern, "".join(c for f, c in flags if p.flags & f)) for p in patterns]
    return re.compile("|".join(f"(?{f}:{p})" if f else f"(?:{p})" for p, f in named))


@dataclass
class Format:
    name: str
    rules: list[Rule]
    spaces: str = " \n\t\r<>~"
    escapes: str = "][^@\\/${}"
    replace: re.Pattern | None = None
    to_text: dict[str, str] = field(default_factory=dict)
    to_source: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.rules = sorted(self.rules, key=lambda r: r.priority)
        self.escaped = re.compile(f"[{re.escape(self.escapes)}]")
        # wherever anything but plain text may begin
        begins = [r.begin for r in self.rules] + ([self.replace] if self.replace else [])
        self.marks = _any([re.compile(f"[{re.escape(self.spaces)}]"), *begins])
        # inside a comment: its end, and the rules of lower priority numbers, which still hold there
        self.inner = {}
        for rule in self.rules:
            if rule.end is not None:
                rules = [r for r in self.rules if r.priority < rule.priority]
                self.inner[rule] = (rules, _any([rule.end, *[r.begin for r in rules]]))

    def escape(self, text: str) -> str:
        return self.escaped.sub(lambda m: "\\" + m[0], text)

    def match(self, text: str, at: int) -> tuple[Rule, int] | None:
        best: tuple[int, Rule] | None = None
        for rule in self.rules:
            m = rule.begin.match(text, at)
            if m and m.end() > at and (best is None or m.end() > best[0]):
                best = (m.end(), rule)
        return (best[1], best[0]) if best else None

    def close(self, text: str, at: int, rule: Rule) -> tuple[int, bool, bool]:
        """Where a comment that was opened before ``at`` ends, and whether it ends a sentence or a heading.

        Rules of lower priority numbers hold inside, comments among them with ends of their own; of
        what begins at one place the longest counts, and a rule before the end.
        """
        open_, eos, eoh = [rule], rule.eos, rule.eoh
        while open_:
            rules, marks = self.inner[open_[-1]]
            m = marks.search(text, at)
            if not m:
                return len(text), eos, eoh
            here = m.start()
            end = open_[-1].end.match(text, here)
            best, found = (end.end() if end else -1), None
            for r in rules:
                m = r.begin.match(text, here)
                if m and m.end() > here and (m.end() > best or found is None and m.end() == best):
                    best, found = m.end(), r
            if found is None:
                if end:
                    open_.pop()
                at = max(best, here if end else here + 1)
                continue
            at, eos, eoh = best, eos or found.eos, eoh or found.eoh
            if found.end is not None:
                open_.append(found)
        return at, eos, eoh


@dataclass
class _Writer:
    fmt: Format
    dot: bool
    always: bool
    headings: bool
    out: list[str] = field(default_factory=list)
    blank: list[str] = field(default_factory=list)
    eos: bool = False
    eoh: bool = False

    def flush(self) -> None:
        blank = "".join(self.blank)
        self.blank = []
        if self.eoh and self.headings:
            self.out.append("[]" + HEADING)
            self.eoh = False
        stop = ".[]" if self.dot else "[]"
        if self.eos and not self.always:
            self.out.append(stop)
            self.eos = False
        if blank and blank != " ":
            escaped = self.fmt.escape(blank)
            self.out.append((stop if self.always and self.eos else "") + "[" + ("\\" if escaped.startswith("@") else "") + escaped + "]")
            if self.always:
                self.eos = False
        else:
            self.out.append(blank)


def deformat(text: str, fmt: Format, dot: bool = True, always: bool = False, headings: bool = False) -> str:
    """The text with all markup in blanks.

    A single space stays bare; an artificial stop comes before a blank that ends a sentence and at
    the end. ``dot`` off writes ``[]`` for it, ``headings`` marks ends of headings, ``always`` puts
    the stop even where no blank is written.
    """
    w = _Writer(fmt, dot, always, headings)
    at = 0
    while at < len(text):
        m = fmt.marks.search(text, at)
        plain = m.start() if m else len(text)
        if plain > at:
            if w.blank or w.eos or w.eoh:
                w.flush()
            w.out.append(fmt.escape(text[at:plain]))
            at = plain
            continue
        found = fmt.match(text, at)
        if found:
            rule, stop = found
            eos, eoh = rule.eos, rule.eoh
            if rule.end is not None:
                stop, eos, eoh = fmt.close(text, stop, rule)
            w.blank.append(text[at:stop])
            w.eos, w.eoh = w.eos or eos, w.eoh or eoh
            at = stop
            continue
        c = text[at]
        if fmt.replace and (m := fmt.replace.match(text, at)) and m[0] in fmt.to_text:
            w.flush()
            w.out.append(fmt.escape(fmt.to_text[m[0]]))
            at = m.end()
        elif c in fmt.spaces:
            w.blank.append(c)
            at += 1
        else:
            if w.blank or w.eos or w.eoh:
                w.flush()
            w.out.append(fmt.escape(c))
            at += 1
    w.eos = True
    w.always = False
    w.flush()
    return "".join(w.out)


_REFORMAT = re.compile(r"\.\[\]|\[\]\u2761|\[\\@|\\(.)|\[|\]|(.)", re.DOTALL)


def reformat(text: str, fmt: Format) -> str:
    """The document again: brackets and artificial stops go, escapes are undone, characters of the
    replacement table get their preferred source in text (not in markup)."""
    out, inside = [], False
    for m in _REFORMAT.finditer(text):
        if m[0] == "[\\@":
            inside = True
            out.append("@")
        elif m[1] is not None:
            out.append(m[1])
        elif m[0] in ("[", "]"):
            inside = m[0] == "["
        elif m[2] is not None:
            out.append(m[2] if inside else fmt.to_source.get(m[2], m[2]))
    return "".join(out)


# the formats

_ARGS = r"(?: [^>]*)?"


def _elements(names: str, close: str = "", **options) -> Rule:
    return tag(rf"<{close}(?:{names}){_ARGS}>", **options)


def _skipped(name: str, **options) -> Rule:
    return comment(rf"<{name}{_ARGS}>", rf"</{name}{_ARGS}>", **options)


_REST = [tag(r"<[!?][a-z][^>]*>", priority=5), tag(r"</?[a-z][^>]*>", priority=5)]
_XML_COMMENT = comment("<!--", "-->", priority=1)
_BLOCKS = "br|hr|p|li|ul|ol|tr|td|th|div|option"
_HTML = [
    _XML_COMMENT,
    comment(r"\{\{", r"\}\}", priority=1),
    *[_skipped(n) for n in ("script", "style")],
    comment(rf"<[a-z]+-notrans{_ARGS}>", r"</[a-z]+-notrans>"),
    _elements(rf"{_BLOCKS}|title|h[1-6]", eos=True),
    _elements(_BLOCKS, "/", eos=True),
    _elements("title|h[1-6]", "/", eos=True, eoh=True),
]

#: Named characters outside ASCII, both ways.
_NAMED = {f"&{name};": chr(code) for code, name in html.entities.codepoint2name.items() if code >= 160}
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);")


class _Entities(dict):
    """Named characters, and numbered ones by rule."""

    def __contains__(self, source: object) -> bool:
        return dict.__contains__(self, source) or (str(source).startswith("&#") and self._numbered(str(source)) is not None)

    def __getitem__(self, source: str) -> str:
        return dict.__getitem__(self, source) if dict.__contains__(self, source) else self._numbered(source)

    @staticmethod
    def _numbered(source: str) -> str | None:
        code = int(source[3:-1], 16) if source[2] in "xX" else int(source[2:-1])
        return chr(code) if 160 <= code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else None


def _rtf(codepage: str) -> Format:
    """Hex escapes of a code page, from the codec of that name."""
    to_text = {}
    for code in range(128, 256):
        try:
            to_text[f"\\'{code:02x}"] = bytes([code]).decode(codepage)
        except UnicodeDecodeError:
            continue
    rules = [
        comment(r"\{\\(?:fonttbl|colortbl|stylesheet|info|pict)\b", r"\}(?=[^}]*\{|[^}]*\\|\s)"),
        comment(r"\{\\\*", r"\}"),
        tag(r"\\(?:par|pard|page|cell|row|tab)\b ?", eos=True, priority=2),
        tag(r"\\[^'][^ \n\r\\{}]*[ \n\r]*"),
        tag(r"[{}]", priority=4),
    ]
    fmt = Format(f"rtf-{codepage}", rules, " \n\t\r", "][^@\\/$", re.compile(r"\\'[0-9a-fA-F]{2}"), to_text, {v: k for k, v in to_text.items()})
    fmt.to_text = {**to_text, **{k.upper().replace("\\'", "\\'"): v for k, v in to_text.items()}}
    return fmt


#: Formats whose braces are blanks and not escaped.
_BRACES = {"spaces": " \n\t\r<>{}~", "escapes": "][^@\\/$"}


def _office(name: str, paragraphs: str, skipped: Iterable[Rule], priority: int = 3, **options) -> Format:
    """Bodies of office documents: only paragraphs end sentences, and so do some skipped parts."""
    rules = [
        _XML_COMMENT,
        *skipped,
        comment(r"&lt;[a-z]+-notrans(?: [^>]*?)?&gt;", r"&lt;/[a-z]+-notrans&gt;"),
        _elements(paragraphs, eos=True, priority=priority),
        _elements(paragraphs, "/", eos=True, priority=priority),
        *_REST,
    ]
    return Format(name, rules, replace=_ENTITY, to_text={"&apos;": "'"}, **options)


_TITLES = "part|chapter|(?:sub)*section|title|frametitle|caption|footnote|framebox|thanks|mline|paragraph"
_OPEN = r"[ \t\n\r]*<(?:CONTENTS|PARAM)>"

FORMATS: dict[str, Format] = {
    f.name: f
    for f in (
        Format("txt", [tag(r"(?:\n\n|\r\n\r\n)+", eos=True, priority=1)], " \n\t\r~", "][\\/@<>^${}"),
        Format("html", [*_HTML, *_REST], replace=_ENTITY, to_text=_Entities(_NAMED), to_source={v: k for k, v in _NAMED.items()}),
        Format("html-noent", [*_HTML, *_REST]),
        Format(
            "html-alt",
            [
                *_HTML,
                tag(r"<link(?: [^>]*)?>", priority=4),
                tag(r"<[!?][a-z][^>]*>", priority=5),
                tag(r"<(?:img|input|area)(?: [^><]+)* alt=[\"']", priority=5),
                tag(r"[\"'][^><]*>", priority=5),
                comment(r"<[a-z]+ ", r">", priority=4),
                tag(r"</[a-z][^>]*>|<[a-z][^> ]*>", priority=5),
            ],
        ),
        _office("odt", "text:[hp]", [_skipped("math:[a-z]+"), comment(r"<math(?: xmlns=[^>]*)?>", r"</math>")], **_BRACES),
        _office("pptx", "a:p", [_skipped(n, eos=True) for n in ("pkg:binaryData", "p:timing")], **_BRACES),
        _office("xlsx", "si", [_skipped("f", eos=True)]),
        _office("wxml", "w:p", [_skipped("Properties"), *[_skipped(n, eos=True, priority=3) for n in ("pkg:binaryData", "w:instrText", "w:drawing")]], priority=4),
        _rtf("cp1250"),
        _rtf("cp1251"),
        Format(
            "mediawiki",
            [
                _XML_COMMENT,
                comment(r"&lt;!--", r"--&gt;", priority=1),
                *[_skipped(n) for n in ("script", "style")],
                comment(rf"<[a-z]+-notrans{_ARGS}>", r"</[a-z]+-notrans>"),
                *[comment(f"<{n}>", f"</{n}>") for n in ("siteinfo", "comment", "id", "contributor", "timestamp")],
                comment(r"\{\{", r"\}\}"),
                comment(r"&lt;math&gt;", r"&lt;/math&gt;"),
                tag(r"[\[\]]|''+", priority=1),
                tag(r"(?m:^)[*=:;#]+", priority=1),
                tag(r"==+", eos=True, priority=1),
                tag(r"\[\[(?:[a-z]{2,3}|image|file):[^\]]*\]\]"),
                _elements(rf"{_BLOCKS}|title|h[1-6]", eos=True),
                _elements(rf"{_BLOCKS}|title|h[1-6]", "/", eos=True),
                *_REST,
                tag(r"&lt;/?[a-z][^&]*&gt;", priority=5),
            ],
            **_BRACES,
        ),
        Format("xpresstag", [tag(r"<[^>]*->", eos=True, priority=1), tag(r"@[^:=\n]*[:=]", eos=True, priority=2), tag(r"<[^>]*>")]),
        Format(
            "latex",
            [
                _XML_COMMENT,
                *[comment(f"<{n}>", f"</{n}>", priority=1) for n in ("COMMENT", "VERB", "MATH")],
                comment(rf"<(?:cite|ref|label|pageref|input|include|bibliography|usepackage|documentclass)(?:_STAR)?/>{_OPEN}", r"</(?:CONTENTS|PARAM)>(?:[ \t\n\r]*<CONTENTS>[^<]*</CONTENTS>)?"),
                tag(rf"<(?:{_TITLES})(?:_STAR)?/>{_OPEN}", eos=True, priority=2),
                tag(r"<item(?:_STAR)?/>(?:<PARAM>)?", eos=True, priority=2),
                tag(rf"<(?:textit|emph|textbf|texttt|underline)(?:_STAR)?/>{_OPEN}", priority=2),
                tag(r"</(?:CONTENTS|PARAM)>", eos=True, priority=4),
                tag(r"<documentclass/>", eos=True, priority=4),
                tag(r"\n\n+", eos=True, priority=4),
                *_REST,
            ],
        ),
    )
}


def format_of(name: str, warn: list[str] | None = None) -> Format:
    """The format of a name; an unknown one falls back to txt, with a warning."""
    if name not in FORMATS and warn is not None:
        warn.append(f"unknown format {name}, taken as txt")
    return FORMATS.get(name, FORMATS["txt"])


def reformat_of(name: str) -> Format:
    """html-alt is written back without entities."""
    return FORMATS["html-noent"] if name == "html-alt" else format_of(name)


def offsets(text: str, fmt: Format) -> list[dict]:
    """The second output form: each blank with its order, the offset of the text before it, and its markup."""
    out, order, offset = [], 0, 0
    for m in re.finditer(r"(?:\.\[\])?\[((?:\\.|[^\]\\])*)\]|\\.|.", deformat(text, fmt), re.DOTALL):
        if m[1] is not None and m[1] != "":
            order += 1
            out.append({"offset": offset, "order": order, "tag": re.sub(r"(?s)\\(.)", r"\1", m[1])})
        elif m[1] is None:
            offset += 1
    return out


# LaTeX

#: Accent commands and the combining characters that they stand for (fixed values).
ACCENTS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", '"': "\u0308", "c": "\u0327", "v": "\u030c", "u": "\u0306", "=": "\u0304", ".": "\u0307", "r": "\u030a", "H": "\u030b", "k": "\u0328"}
#: Letters with a command of their own (fixed values).
LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å", "i": "ı"}
_ACCENT = re.compile(r"\\([`'^~\"=.])\s*(?:\{(\\?[A-Za-z])\}|(\\?[A-Za-z])(?![A-Za-z])|([A-Za-z]))|\\([cvurHk])\{(\\?[A-Za-z])\}")
_LETTER = re.compile(r"\\(ss|ae|AE|oe|OE|aa|AA|o|O|l|L|i)(?:\{\}| |(?![A-Za-z]))")


def accents_to_text(text: str) -> str:
    def accent(m: re.Match) -> str:
        letter = (m[2] or m[3] or m[4] or m[6]).lstrip("\\")
        return unicodedata.normalize("NFC", letter + ACCENTS[m[1] or m[5]])

    return _LETTER.sub(lambda m: LETTERS[m[1]], _ACCENT.sub(accent, text))


def text_to_accents(text: str) -> str:
    letters, marks = {v: k for k, v in LETTERS.items()}, {v: k for k, v in ACCENTS.items()}
    out = []
    for c in text:
        base = unicodedata.normalize("NFD", c)
        if c in letters:
            out.append(f"\\{letters[c]}{{}}")
        elif len(base) == 2 and base[1] in marks:
            out.append(f"\\{marks[base[1]]}{{{base[0]}}}")
        else:
            out.append(c)
    return "".join(out)


_PRE = re.compile(
    r"(?P<verb>\\begin\{(?P<env>verbatim\*?|lstlisting)\}.*?\\end\{(?P=env)\}|\\verb\*?(?P<d>[^A-Za-z\s]).*?(?P=d))"
    r"|(?P<math>\$\$.*?\$\$|\$(?:\\.|[^$\\])*\$|\\\[.*?\\\]|\\\(.*?\\\)|\\begin\{(?P<m>equation\*?|align\*?|displaymath|eqnarray\*?)\}.*?\\end\{(?P=m)\})"
    r"|(?P<comment>%[^\n]*\n?)"
    r"|\\begin\{(?P<open>[A-Za-z]+)(?P<ostar>\*?)\}|\\end\{(?P<close>[A-Za-z]+)(?P<cstar>\*?)\}"
    r"|\\(?P<command>[A-Za-z]+)(?P<star>\*?)|\\(?P<other>.)|(?P<brace>[{}])|(?P<plain>[<>&])",
    re.DOTALL,
)
_ENTITIES = {"<": "&lt;", ">": "&gt;", "&": "&amp;"}


def prelatex(text: str) -> str:
    """LaTeX as tags: commands, environments, groups, options after commands, verbatim, mathematics."""
    text = accents_to_text(text)
    out, at, depth = [], 0, []

    def plain(part: str) -> str:
        return re.sub("[<>&]", lambda m: _ENTITIES[m[0]], part)

    while at < len(text):
        m = _PRE.search(text, at)
        stop = m.start() if m else len(text)
        chunk = text[at:stop]
        if depth and depth[-1] == "PARAM" and "]" in chunk:
            cut = chunk.index("]")
            out += [plain(chunk[:cut]), "</PARAM>"]
            depth.pop()
            at += cut + 1
            continue
        out.append(plain(chunk))
        if not m:
            break
        at = m.end()
        for kind, name in (("verb", "VERB"), ("math", "MATH"), ("comment", "COMMENT")):
            if m[kind] is not None:
                out.append(f"<{name}>{plain(m[kind])}</{name}>")
        if m["open"]:
            out.append(f"<{m['open']}{'_STAR' if m['ostar'] else ''}>")
        elif m["close"]:
            out.append(f"</{m['close']}{'_STAR' if m['cstar'] else ''}>")
        elif m["command"]:
            out.append(f"<{m['command']}{'_STAR' if m['star'] else ''}/>")
            if text.startswith("[", at):
                out.append("<PARAM>")
                depth.append("PARAM")
                at += 1
        elif m["other"] is not None:
            out.append(f"<ESC-{ord(m['other']):x}/>")
        elif m["brace"] == "{":
            out.append("<CONTENTS>")
            depth.append("CONTENTS")
        elif m["brace"] == "}":
            out.append("</CONTENTS>")
            if depth:
                depth.pop()
        elif m["plain"]:
            out.append(_ENTITIES[m["plain"]])
    return "".join(out)


def postlatex(text: str, accents: bool = False) -> str:
    """The inverse; ``accents`` writes accented letters as commands."""

    def back(m: re.Match) -> str:
        name = m[2].removesuffix("_STAR")
        star = "*" if m[2].endswith("_STAR") else ""
        if name in ("VERB", "MATH", "COMMENT"):
            return ""
        if name in ("CONTENTS", "PARAM"):
            return ("]" if name == "PARAM" else "}") if m[1] else ("[" if name == "PARAM" else "{")
        if name.startswith("ESC-"):
            return "\\" + chr(int(name[4:], 16))
        if m[3]:
            return f"\\{name}{star}"
        return f"\\{'end' if m[1] else 'begin'}{{{name}{star}}}"

    out = re.sub(r"<(/?)([A-Za-z][A-Za-z0-9_-]*)(/?)>", back, text)
    out = out.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
    return text_to_accents(out) if accents else out


def deformat_latex(text: str) -> str:
    return deformat(prelatex(text), FORMATS["latex"])


def reformat_latex(text: str, accents: bool = False) -> str:
    return postlatex(reformat(text, FORMATS["latex"]), accents)

"""Lexical facts of TypeScript and JavaScript sources and of their manifests, with DataFrame functions only.

This reads tokens, not syntax trees: comments, strings, templates and regular expressions are told apart by one
pattern, and imports, exports and branch points are found in what is left.  All repetitions of groups are possessive, so
that no text is too long for the matcher's stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import js

#: A mark, in ten letters of the private use area, with the number of the line that begins behind it; and blanks with such marks among them.
_DIGITS = "".join(chr(0xE000 + k) for k in range(10))
_MARK = r"[\x{E000}-\x{E009}]+"
_GAP = r"[\s\x{E000}-\x{E009}]"
_NAME = r"[\w$]+"

_DOUBLE = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
_SINGLE = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
# a slash begins a regular expression where an operand may begin: behind an operator, an opening bracket or one of these words
_BLANKS = rf"{_GAP}{{0,200}}"
_OPERAND = (
    rf"(?<=(?:\A|[(\[{{,;:?&|^~*%]|=>|(?<![=!<>])[=!]|(?<![\w$)\]])!|[=!]==?|(?<!\+)\+|(?<!-)-|\}}{_BLANKS}\n"
    rf"|(?<![\w$.])(?:return|typeof|case|in|of|do|else|void|delete|throw|new|instanceof|yield|await)){_BLANKS})"
)
_REGEX = rf"(?=/[^*/]){_OPERAND}/[^/\\\[\n]*+(?:(?:\\[^\n]|\[[^\]\\\n]*+(?:\\[^\n][^\]\\\n]*+)*+\])[^/\\\[\n]*+)*+/[a-z]*"


def _template(depth: int) -> str:
    """A template whose substitutions may hold strings, and braces and templates down to a depth."""
    within = f"{_DOUBLE}|{_SINGLE}" + (rf"|{_template(depth - 1)}|\{{{_expression(depth - 1)}\}}" if depth else "") + "|/"
    return rf"`[^`\\$]*+(?:(?:\\[\s\S]|\$(?!\{{)|\$\{{{_expression(depth, within)}\}})[^`\\$]*+)*+`"


def _expression(depth: int, within: str | None = None) -> str:
    within = within or f"{_DOUBLE}|{_SINGLE}" + (rf"|{_template(depth - 1)}|\{{{_expression(depth - 1)}\}}" if depth else "") + "|/"
    return rf"""[^{{}}`"'/]*+(?:(?:{within})[^{{}}`"'/]*+)*+"""


def _balanced(depth: int) -> str:
    """A pair of brackets with what is in it, down to a depth."""
    within = rf"(?:{_balanced(depth - 1)}[^\[\]{{}}()]*+)*+" if depth else ""
    return rf"[\[{{(][^\[\]{{}}()]*+{within}[\]}})]"


_STRING = rf"{_DOUBLE}|{_SINGLE}|{_template(3)}|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
_PIECE = rf"{_STRING}|{_REGEX}|{_COMMENT}|[^\"'`/]+|[\s\S]"
_QUOTED = r"""["'`]([^"'`\\$]*)["'`]"""
_BRACKETS = _balanced(20)


def _pieces(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(_PIECE), 0)


def _is_comment(piece: Column) -> Column:
    return piece.startswith("//") | piece.startswith("/*")


def _is_regex(piece: Column) -> Column:
    return piece.startswith("/") & (F.length(piece) > 1)


def _is_string(piece: Column) -> Column:
    return (F.length(piece) > 1) & F.substring(piece, 1, 1).isin('"', "'", "`")


def _blank(piece: Column) -> Column:
    return F.regexp_replace(piece, r"[^\n]", " ")


def blank_comments(content: Column) -> Column:
    """Comments as blanks; line feeds, strings and regular expressions stay."""
    return F.array_join(F.transform(_pieces(content), lambda p: F.when(_is_comment(p), _blank(p)).otherwise(p)), "")


def code_only(content: Column) -> Column:
    """Comments as blanks, strings without their contents, and regular expressions as a 0."""
    quote = lambda p: F.substring(p, 1, 1)
    change = lambda p: F.when(_is_comment(p), _blank(p)).when(_is_regex(p), "0").when(_is_string(p), F.concat(quote(p), quote(p))).otherwise(p)
    return F.array_join(F.transform(_pieces(content), change), "")


def static_string(literal: Column) -> Column:
    """The content of a literal without escapes and substitutions, else null."""
    return F.nullif(F.regexp_extract(literal, rf"\A{_QUOTED}\z", 1), F.lit(""))


def cyclomatic(content: Column) -> Column:
    """1 and the branch points: if, for, while, do, catch, case, conditions, and the logical operators.

    A `while` that ends a `do` isn't another one.  `?.`, optional members and parameters don't count."""
    def points(code: Column) -> Column:
        count = lambda text, pattern: F.size(F.regexp_extract_all(text, F.lit(pattern), 0))
        words = count(code, r"(?<![\w$.])(?:if|for|while|do|catch|case)(?![\w$]|\s*:)")
        loops = count(code, r"(?<![\w$.])do(?![\w$]|\s*:)")
        logic = count(code, r"&&=?|\|\|=?|\?\?=?")
        ternary = count(F.regexp_replace(code, r"\?\?=?", "  "), r"\?(?!\.(?!\d)|\s*[:,)\]=;}])")
        return (1 + words - loops + logic + ternary).cast("long")

    return js.let(code_only(content), points)


def _with_numbers(pieces: Column) -> Column:
    """Code whose strings are their pieces' numbers, without comments and regular expressions."""
    change = lambda p, k: F.when(_is_comment(p), _blank(p)).when(_is_regex(p), "0").when(_is_string(p), F.concat(F.lit('"'), k.cast("string"), F.lit('"'))).otherwise(p)
    return F.array_join(F.transform(pieces, change), "")


def _spec(pieces: Column, number: Column) -> Column:
    """The content of a numbered string without escapes and substitutions, else null."""
    return static_string(F.get(pieces, number.cast("int")))


def imports(content: Column) -> Column:
    """Array of (spec, names, namespace): import statements, re-exports, require() and import() with fixed strings.

    A default import has the name `default`; a side effect has no names; `* as`, require() and import() take
    the whole module.  What strings, comments and regular expressions hold is no import."""
    # everything between two specifiers that can be an import clause
    pattern = (
        rf"(?<![\w$.])(?:import\s+(?:type\s+)?([\w$\s{{}},*]+?)\s*from\s*|import\s+{_NAME}\s*=\s*(require)\s*\(\s*|(import)\s*|((?:import|require)\s*\((?=\s*\"\d+\"\s*[,)]))\s*|export\s+(?:type\s+)?(\{{[^{{}}]*\}})\s*from\s*)\"(\d+)\""
    )

    def rows(code: Column) -> Column:
        group = lambda k: F.regexp_extract_all(code, F.lit(pattern), k)
        return F.arrays_zip(group(1).alias("clause"), group(2).alias("equals"), group(4).alias("call"), group(5).alias("forward"), group(6).alias("spec"))

    def site(r: Column, pieces: Column) -> Column:
        braces = F.regexp_extract(F.concat(r["clause"], r["forward"]), r"\{([^{}]*)\}", 1)
        listed = F.transform(F.split(braces, ","), lambda n: F.regexp_extract(F.regexp_replace(js.trim(n), r"\Atype\s+", ""), rf"\A({_NAME})", 1))
        named = F.filter(listed, lambda n: n != "")
        default = F.when(F.regexp_extract(js.trim(r["clause"]), rf"\A({_NAME})", 1) != "", F.array(F.lit("default"))).otherwise(F.array().cast("array<string>"))
        whole = r["clause"].contains("*") | (r["call"] != "") | (r["equals"] != "")
        return F.struct(_spec(pieces, r["spec"]).alias("spec"), F.concat(default, named).alias("names"), whole.alias("namespace"))

    found = js.let(_pieces(content), lambda pieces: F.transform(js.let(_with_numbers(pieces), rows), lambda r: site(r, pieces)))
    return F.filter(found, lambda i: i["spec"].isNotNull())


def stars(content: Column) -> Column:
    """Specifiers of `export * from`."""
    found = lambda pieces: F.regexp_extract_all(_with_numbers(pieces), F.lit(r'(?<![\w$.])export\s*\*\s*from\s*"(\d+)"'), 1)
    return F.filter(js.let(_pieces(content), lambda pieces: F.transform(found(pieces), lambda n: _spec(pieces, n))), lambda x: x.isNotNull())


def _numbered(content: Column) -> Column:
    """The code with a mark at the beginning of each line, and strings without their contents."""
    marked = F.array_join(F.transform(js.lines(content), lambda x, k: F.concat(F.translate((k + 1).cast("string"), "0123456789", _DIGITS), x)), "\n")
    kept = lambda p, mark: F.array_join(F.regexp_extract_all(p, F.lit(mark), 0), " ")
    change = lambda p: F.when(_is_comment(p), F.concat(F.lit(" "), kept(p, rf"\n{_MARK}"))).when(_is_regex(p), "0").when(_is_string(p), F.concat(F.lit("''"), kept(p, _MARK))).otherwise(p)
    return F.array_join(F.transform(_pieces(marked), change), "")


def _last_mark(text: Column) -> Column:
    """The number of the last line mark in a text; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(_MARK), 0)
    return F.translate(F.get(found, F.size(found) - 1), _DIGITS, "0123456789").cast("int")


def _named_pieces(text: Column, line: Column, name) -> Column:
    """(name, line) of the parts between commas; name: the column that a part's name is."""
    start = F.struct(line.alias("line"), F.array().cast("array<struct<name:string,line:int>>").alias("found"))

    def step(s: Column, part: Column) -> Column:
        before = F.coalesce(_last_mark(F.regexp_extract(part, rf"\A{_GAP}*", 0)), s["line"])
        own = F.array(F.struct(name(part).alias("name"), before.alias("line")))
        return F.struct(F.coalesce(_last_mark(part), s["line"]).alias("line"), F.concat(s["found"], own).alias("found"))

    return F.filter(F.aggregate(F.split(text, ","), start, step, lambda s: s["found"]), lambda r: r["name"] != "")


# of `const a: T = x, { b } = y` one part: what it binds, its type, and its value up to a comma, a semicolon or a line's end that ends it
_ANGLES = rf"<[^<>()={{}};]*+(?:<[^<>()={{}};]*+(?:<[^<>()={{}};]*+>[^<>()={{}};]*+)*+>[^<>()={{}};]*+)*+>"
_GOES_ON = rf"(?<=[=+\-*/%&|^?:,(<>!~.]\s{{0,20}})\n{_MARK}|\n(?={_GAP}*+[.,+\-*/%&|^?:=<>(\[`])"
_TYPE = rf"{_GAP}*+:(?:=>|[^=,;\[\]{{}}()<>\n]|{_ANGLES}|{_BRACKETS}|{_GOES_ON})*+"
_VALUE = rf"{_GAP}*+=(?![=>])(?:[^,;\[\]{{}}()\n<]|{_ANGLES}(?=\()|<|{_BRACKETS}|{_GOES_ON})*+"
_BOUND = rf"(?:\A(?:declare{_GAP}+)?(?:const|let|var)(?![\w$])(?!{_GAP}+enum(?![\w$]))|\G{_GAP}*+,)({_GAP}*+)({_NAME}|{_BRACKETS})(!?(?:{_TYPE})?(?:{_VALUE})?)"


def _names_of(pattern: Column) -> Column:
    """A binding pattern as the names that it binds, between commas; a plain name as it is."""
    bare = F.regexp_replace(pattern, rf"=(?!>)(?:[^,\[\]{{}}()]|{_BRACKETS})*+", "")  # defaults
    bare = F.regexp_replace(bare, rf"(?:{_NAME}|''|\[[^\[\]]*+\]){_GAP}*+:", "")  # keys
    return F.regexp_replace(F.regexp_replace(bare, r"[\[\]{}]", ","), r"\.\.\.", "")


def exports(content: Column) -> Column:
    """Array of (name, line): declarations and all their bindings, lists (the name that is offered), `* as name` and default.

    An export counts wherever it stands on its line, if it is inside no braces, as those inside blocks aren't the file's own."""
    word = rf"(?<![\w$.])export(?![\w$])(?={_GAP}*+[\w$*{{@])"
    chunks = F.split(_numbered(content), rf"(?={word})")
    braces = lambda c: F.length(F.regexp_replace(c, r"[^{]", "")) - F.length(F.regexp_replace(c, r"[^}]", ""))
    start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("line"), F.array().cast("array<struct<text:string,line:int>>").alias("own"))

    def place(s: Column, c: Column) -> Column:
        here = F.array(F.struct(c.alias("text"), s["line"].alias("line")))
        own = F.when((s["depth"] == 0) & c.rlike(rf"\A{word}"), F.concat(s["own"], here)).otherwise(s["own"])
        return F.struct((s["depth"] + braces(c)).alias("depth"), F.coalesce(_last_mark(c), s["line"]).alias("line"), own.alias("own"))

    before = rf"\A{_GAP}*+(?:@[\w$.]+(?:{_BRACKETS})?{_GAP}*+)*+"
    kinds = rf"(?:declare{_GAP}+)?(?:abstract{_GAP}+)?(?:async{_GAP}+)?(?:const{_GAP}+enum|function{_GAP}*\*?|class|interface|type|enum|namespace|module)"
    kind, space = rf"\A{kinds}{_GAP}*(?<![\w$])", rf"\A\*{_GAP}*as{_GAP}+"
    marks = lambda t: F.array_join(F.regexp_extract_all(t, F.lit(_MARK), 0), "\n")

    def one(body: Column, line: Column) -> Column:
        default = body.rlike(r"\Adefault(?![\w$])")
        at = F.concat(F.regexp_extract(body, kind, 0), F.regexp_extract(body, space, 0))
        name = F.when(default, F.lit("default")).otherwise(F.concat(F.regexp_extract(body, rf"{kind}({_NAME})", 1), F.regexp_extract(body, rf"{space}({_NAME})", 1)))
        single = F.array(F.struct(name.alias("name"), F.when(default, line).otherwise(F.coalesce(_last_mark(at), line)).alias("line")))
        return F.filter(single, lambda r: r["name"] != "")

    def bound(body: Column, line: Column) -> Column:
        group = lambda k: F.regexp_extract_all(body, F.lit(_BOUND), k)
        parts = F.arrays_zip(group(1).alias("gap"), group(2).alias("head"), group(3).alias("rest"))
        flat = F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], _names_of(p["head"]), F.lit(","), marks(p["rest"]))), ",")
        return _named_pieces(flat, line, lambda x: F.regexp_extract(x, rf"\A{_GAP}*({_NAME}){_GAP}*\z", 1))

    def found(c: Column) -> Column:
        rest = F.regexp_replace(c["text"], r"\Aexport", "")
        return js.let(F.struct(F.regexp_replace(rest, before, "").alias("body"), F.coalesce(_last_mark(F.regexp_extract(rest, before, 0)), c["line"]).alias("line")), names)

    def names(c: Column) -> Column:
        body, line = c["body"], c["line"]
        listed = F.regexp_extract(body, rf"\A((?:type{_GAP}+)?\{{[^}}]*)", 1)
        offered = _named_pieces(F.regexp_replace(listed, r"\A[^{]*\{", ""), line, lambda x: F.regexp_extract(x, rf"({_NAME}){_GAP}*\z", 1))
        binds = body.rlike(rf"\A(?:declare{_GAP}+)?(?:const|let|var)(?![\w$])(?!{_GAP}+enum(?![\w$]))")
        return F.when(body.rlike(rf"\A(?:type{_GAP}+)?\{{"), offered).when(binds, bound(body, line)).otherwise(one(body, line))

    return F.flatten(F.transform(F.aggregate(chunks, start, place, lambda s: s["own"]), found))


def scan(files: DataFrame, content: str = "content") -> DataFrame:
    """files without contents, with loc, complexity, imports, exports and stars."""
    own, code = [c for c in files.columns if c != content], F.col(content)
    return files.select(
        *own, F.size(js.lines(F.col(content))).cast("long").alias("loc"), cyclomatic(F.col(content)).alias("complexity"),
        imports(code).alias("imports"), exports(code).alias("exports"), stars(code).alias("stars"),
    )


# -- manifests


def strict_json(text: Column) -> Column:
    """JSON with comments and trailing commas as plain JSON; strings are left alone."""
    piece = r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])|[^",]+|[\s\S]'
    # a comma that matches the pattern with its look-ahead is one piece, as any other comma, so it is told by what follows
    pieces = F.regexp_extract_all(blank_comments(text), F.lit(rf"({piece})(\s*[}}\]])?"), 0)
    return F.array_join(F.transform(pieces, lambda p: F.regexp_replace(p, r"\A,(\s*[}\]])\z", "$1")), "")


def dependencies(manifests: DataFrame, text: str = "text") -> DataFrame:
    """(path, name, line) of `dependencies` in each manifest; the line is the one in that block that begins with the name."""
    block = F.map_keys(F.from_json(F.get_json_object(text, "$.dependencies"), "map<string,string>"))
    lines = F.transform(F.split(text, "\n"), js.trim)
    begin = F.array_position(F.transform(lines, lambda x: x.startswith('"dependencies"')), True)
    inside = F.when(begin > 0, F.slice(lines, (begin + 1).cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    each = manifests.select("path", begin.alias("_b"), inside.alias("_l"), F.explode(block).alias("name"))
    at = F.array_position(F.transform("_l", lambda x: x.startswith(F.concat(F.lit('"'), F.col("name"), F.lit('"')))), True)
    close = F.array_position(F.transform("_l", lambda x: x.startswith("}")), True)
    return each.select("path", "name", F.when((at > 0) & ((close == 0) | (at < close)), F.col("_b") + at).alias("line"))


def entry_values(manifests: DataFrame, text: str = "text") -> DataFrame:
    """(path, value): strings anywhere in the entry fields of a manifest, and source paths in its scripts."""
    # fixed values: the fields that name files, and the form of a path in a script
    fields = [F.get_json_object(text, f"$.{f}") for f in ("main", "module", "browser", "types", "typings", "bin", "exports")]
    token = F.lit(r'"((?:\\.|[^"\\])*)"(\s*:)?')

    def nested(c: Column) -> Column:
        found = F.zip_with(F.regexp_extract_all(c, token, 1), F.regexp_extract_all(c, token, 2), lambda s, colon: F.when(colon == "", s))
        return F.when(js.trim(c).rlike(r"\A[{\[]"), F.filter(found, lambda s: s.isNotNull())).when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))

    scripts = F.coalesce(F.map_values(F.from_json(F.get_json_object(text, "$.scripts"), "map<string,string>")), F.array().cast("array<string>"))
    run = F.flatten(F.transform(scripts, lambda s: F.regexp_extract_all(s, F.lit(r"(?:^|\s)([\w./@-]+\.[cm]?[jt]sx?)(?=\s|\z)"), 1)))
    return manifests.select("path", F.explode(F.array_distinct(F.concat(*[nested(c) for c in fields], run))).alias("value"))

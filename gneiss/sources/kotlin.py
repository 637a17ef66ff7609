"""Symbols and call sites of Kotlin source.

Rows are dictionaries; missing keys are null. Declarations are read to their full structure, bodies are
searched for calls, operators and index accesses without building a tree.
"""

from __future__ import annotations

from .lexing import OPENERS, Cursor

MODIFIERS = set("public private protected internal abstract final open override lateinit const suspend inline noinline crossinline tailrec operator infix external data sealed enum inner annotation companion vararg expect actual value fun reified".split())
# Words that are no names where an expression may stand.
HARD = set("if else when while for do try catch finally return throw in is as val var fun class interface object this super null true false break continue typealias package".split())
NOT_CALLED = set("if else when while for do try catch finally return throw in is as val var fun class interface object null true false break continue typealias get set init constructor".split())

# Operators and the functions they stand for.
BINARY = {
    "+": "plus", "-": "minus", "*": "times", "/": "div", "%": "rem", "+=": "plusAssign", "-=": "minusAssign", "*=": "timesAssign", "/=": "divAssign", "%=": "remAssign",
    "==": "equals", "<": "compareTo", ">": "compareTo", "<=": "compareTo", ">=": "compareTo", "..": "rangeTo",
}
UNARY = {"+": "unaryPlus", "-": "unaryMinus", "!": "not", "++": "inc", "--": "dec"}


def simple(text: str) -> str:
    return text.strip().split("<", 1)[0].rsplit(".", 1)[-1].strip()


def signature(name: str, params: list[dict]) -> str:
    return f"{name}({', '.join(p['type'] for p in params)})"


class KotlinFile:
    def __init__(self, path: str, source: str, sought: bool = True):
        self.path, self.c, self.sought = path, Cursor(source, True), sought
        self.symbols: list[dict] = []
        self.sites: list[dict] = []

    def add(self, **row) -> dict:
        row |= {"file_path": self.path, "language": "KOTLIN"}
        self.symbols.append(row)
        return row

    # --- declarations ---

    def read(self) -> KotlinFile:
        c, self.package = self.c, ""
        functions, properties = [], []
        while not c.done:
            if c.is_("package", "import"):
                start = c.at + 1
                kind = c.texts[c.at]
                c.at += 1
                while not c.done and not c.fresh[c.at] and not c.is_(";"):
                    c.at += 1
                if kind == "package":
                    self.package = c.text(start, c.at).replace(" ", "")
                continue
            found = self.declaration(self.package)
            if found and found[0] == "fun":
                functions.append(found[1])
            elif found and found[0] == "property":
                properties.append(found[1])
        if functions or properties:
            file = self.path.replace("\\", "/").rsplit("/", 1)[-1]
            base = file[:-3] if file.endswith(".kt") else file
            name = base[0].upper() + base[1:] + "Kt" if base.strip() else "TopLevelKt"
            owner = self.qualify(self.package, name)
            facade = self.add(id=owner, kind="CLASS", simple_name=name, line=1, annotations=["@FileFacade"], raw_annotations=[], super_class="", interfaces=[], supertypes=[], field_ids=[], method_ids=[])
            for f in functions:
                self.function(f, owner, facade)
            for p in properties:
                self.property(p, owner, facade)
        return self

    @staticmethod
    def qualify(package: str, name: str) -> str:
        return f"{package}.{name}" if package.strip() else name

    def declaration(self, qualifier: str, owner: dict | None = None):
        """Read one declaration; classes are added at once, functions and properties are returned."""
        c = self.c
        start = c.at
        annotations, modifiers = self.prefix()
        if c.is_("fun") and not (c.is_("interface", ahead=1)):
            return "fun", self.read_function(start, annotations, modifiers)
        if c.is_("val", "var"):
            return "property", self.read_property(start, annotations)
        if c.is_("class", "interface", "object") or c.is_("fun"):
            c.take("fun")
            self.class_(qualifier, start, annotations)
            return None
        if c.is_("constructor") and c.is_("(", ahead=1):
            return "constructor", self.read_constructor(start, annotations)
        if c.is_("init") and c.is_("{", ahead=1):
            c.at = c.past(c.at + 1)
            return None
        if c.is_("typealias"):
            c.at += 1
            while not c.done and not c.fresh[c.at] and not c.is_(";"):
                c.at += 1
            return None
        if c.texts[c.at] in OPENERS and c.kinds[c.at] == "op":
            c.at = c.past(c.at)
        elif not c.done:
            c.at += 1
        return None

    def prefix(self) -> tuple[list[dict], list[str]]:
        """Annotations and modifiers in front of a declaration."""
        c, annotations, modifiers = self.c, [], []
        while True:
            text = c.texts[c.at]
            if text == "@":
                annotations += self.annotation()
            elif text in MODIFIERS and not c.is_("(", ".", "=", ":", ahead=1) and not (c.is_("fun") and not c.is_("interface", ahead=1)):
                if c.is_("companion") and c.is_("object", ahead=1) and not c.kinds[c.at + 2] == "id":
                    modifiers.append("companion")
                    c.at += 1
                    break
                if c.is_("fun"):
                    break
                modifiers.append(c.texts[c.at])
                c.at += 1
            else:
                break
        return annotations, modifiers

    def annotation(self) -> list[dict]:
        c = self.c
        c.take("@")
        if c.kinds[c.at] == "id" and c.is_(":", ahead=1):
            c.at += 2
        if c.is_("["):
            end, out = c.partner[c.at], []
            c.at += 1
            while c.at < end:
                out.append(self.annotation_body())
            c.at = end + 1
            return out
        return [self.annotation_body()]

    def annotation_body(self) -> dict:
        c = self.c
        name = c.texts[c.at]
        c.at += 1
        while c.is_(".") and c.kinds[c.at + 1] == "id":
            name = c.texts[c.at + 1]
            c.at += 2
        if c.is_("<") and (after := c.type_arguments(c.at)):
            c.at = after
        args = []
        if c.is_("(") and not c.fresh[c.at]:
            for i, j in c.parts(c.at + 1, c.partner[c.at]):
                key = ""
                if c.kinds[i] == "id" and c.texts[i + 1] == "=":
                    key, i = c.texts[i], i + 2
                if j == i + 1 and c.kinds[i] in ("str", "num") or c.texts[i] in ("true", "false", "null"):
                    args.append({"name": key, "value": c.text(i, j)})
                elif key and j - i >= 3 and c.texts[j - 2] == "." and c.kinds[j - 1] == "id":
                    args.append({"name": key, "value": c.texts[j - 1].upper()})
            c.at = c.past(c.at)
        return {"name": name, "args": args}

    def type_end(self, i: int, stop: int) -> int:
        """The place after a type that starts at i."""
        c = self.c
        while i < stop:
            text, kind = c.texts[i], c.kinds[i]
            if text in ("suspend",) and kind == "id":
                i += 1
            elif text == "@":
                i += 2
            elif text == "(" and kind == "op":
                i = c.past(i)
            elif kind == "id":
                i += 1
                if c.texts[i] == "<" and (after := c.type_arguments(i)):
                    i = after
            else:
                return i
            while i < stop and c.texts[i] == "?":
                i += 1
            if i < stop and c.texts[i] in (".", "->", "&") and c.kinds[i] == "op":
                i += 1
                continue
            return i
        return i

    def parameters(self, at: int) -> list[dict]:
        """name, type, and what is declared in front of each parameter in the brackets that open at `at`."""
        c, out = self.c, []
        back = c.at
        for i, j in c.parts(at + 1, c.partner[at]):
            c.at = i
            annotations, _ = self.prefix()
            keyword = c.texts[c.at] if c.is_("val", "var") else ""
            if keyword:
                c.at += 1
            name, line = c.texts[c.at], c.lines[i]
            type_, function = "", False
            if c.at + 1 < j and c.texts[c.at + 1] == ":":
                end = self.type_end(c.at + 2, j)
                type_ = c.text(c.at + 2, end)
                function = "->" in c.texts[c.at + 2 : end] and c.texts[c.at + 2] != "<" and (c.texts[c.at + 2] in ("(", "suspend") or c.texts[end - 1] != ">") and not type_.endswith("?")
            out.append({"name": name, "type": type_ or "Any", "declared": type_, "keyword": keyword, "annotations": annotations, "line": line, "function": function})
        c.at = back
        return out

    @staticmethod
    def labels(annotations: list[dict]) -> list[str]:
        return [f"@{a['name']}" for a in annotations]

    def class_(self, qualifier: str, start: int, annotations: list[dict]) -> None:
        c = self.c
        object_ = c.is_("object")
        c.at += 1
        named = c.kinds[c.at] == "id" and not c.fresh[c.at] and c.texts[c.at] not in ("where",)
        name = c.texts[c.at] if named else "Companion" if object_ else ""
        if named:
            c.at += 1
        if c.is_("<") and (after := c.type_arguments(c.at)):
            c.at = after
        primary_at, params, header = c.at, None, []
        header, _ = self.prefix()
        if c.is_("constructor"):
            c.at += 1
        elif header:
            header = []
        if c.is_("("):
            params = self.parameters(c.at)
            line = c.lines[primary_at]
            c.at = c.past(c.at)
        supertypes = []
        if c.take(":"):
            while True:
                end = self.type_end(c.at, len(c.texts) - 1)
                supertypes.append(simple(c.text(c.at, end)))
                c.at = max(end, c.at + 1) if end == c.at else end
                if c.is_("(") and not c.fresh[c.at]:
                    c.at = c.past(c.at)
                if c.take("by"):
                    while not c.done and not c.is_(",", "{") and not c.fresh[c.at]:
                        c.at = c.past(c.at) if c.texts[c.at] in OPENERS and c.kinds[c.at] == "op" else c.at + 1
                if not c.take(","):
                    break
        if c.is_("where"):
            while not c.done and not c.is_("{") and not (c.fresh[c.at] and not c.is_("where")):
                c.at += 1
        class_id = self.qualify(qualifier, name)
        row = self.add(id=class_id, kind="CLASS", simple_name=name, line=c.lines[start], annotations=self.labels(annotations), raw_annotations=annotations, super_class=supertypes[0] if supertypes else "", interfaces=supertypes[1:], supertypes=supertypes, field_ids=[], method_ids=[])
        if params is not None:
            self.constructor((line, header, params, None), class_id, name, row)
            for p in params:
                if p["keyword"]:
                    self.field(class_id, p["name"], f"{p['keyword']} {p['declared']}".strip(), p["line"], p["annotations"], row)
        if c.is_("{"):
            end = c.partner[c.at]
            c.at += 1
            later, constructors = [], []
            self.enum_entries(start, end)
            while c.at < end:
                place = len(self.symbols)
                found = self.declaration(self.qualify(qualifier, name), row)
                if found and found[0] == "constructor":
                    constructors.append(found[1])
                elif found:
                    later.append((found, None))
                elif len(self.symbols) > place:
                    nested, self.symbols = self.symbols[place:], self.symbols[:place]
                    later.append((None, nested))
            c.at = end + 1
            for k in constructors:
                self.constructor(k, class_id, name, row)
            for found, nested in later:
                if nested is not None:
                    self.symbols += nested
                elif found[0] == "fun":
                    self.function(found[1], class_id, row)
                else:
                    self.property(found[1], class_id, row)

    def enum_entries(self, start: int, end: int) -> None:
        """Step over the entries of an enum class."""
        c = self.c
        if not "enum" in c.texts[start : c.at]:
            return
        while c.at < end and not c.is_(";"):
            if c.kinds[c.at] == "id" and c.texts[c.at] in (MODIFIERS | {"val", "class"}) and c.fresh[c.at] and c.texts[c.at - 1] not in (",", "{"):
                return
            c.at = c.past(c.at) if c.texts[c.at] in OPENERS and c.kinds[c.at] == "op" else c.at + 1
        c.take(";")

    def read_function(self, start: int, annotations: list[dict], modifiers: list[str]):
        c = self.c
        c.take("fun")
        if c.is_("<") and (after := c.type_arguments(c.at)):
            c.at = after
        # The name is the last identifier before the parameters; what stands before its dot is the receiver.
        i = c.at
        while not (c.texts[i] == "(" and c.kinds[i] == "op" and i > c.at and c.kinds[i - 1] == "id") and c.kinds[i] != "end":
            if c.texts[i] == "<" and (after := c.type_arguments(i)):
                i = after
            elif c.texts[i] == "(" and c.kinds[i] == "op":
                i = c.past(i)
            else:
                i += 1
        name, receiver = c.texts[i - 1], c.text(c.at, i - 2) if i - 2 > c.at else ""
        if c.kinds[i] == "end":
            c.at = i
            return None
        params = self.parameters(i)
        c.at = c.past(i)
        returns = "Unit"
        if c.take(":"):
            end = self.type_end(c.at, len(c.texts) - 1)
            returns = c.text(c.at, end)
            c.at = end
        if c.is_("where"):
            while not c.done and not c.is_("{", "="):
                c.at += 1
        body = self.body()
        return c.lines[start], annotations, modifiers, name, receiver, params, returns, body

    def body(self) -> tuple[int, int] | None:
        c = self.c
        if c.is_("{"):
            i = c.at
            c.at = c.past(i)
            return i, c.at
        if c.take("="):
            i = c.at
            c.at = self.expression_end(i)
            return i, c.at
        return None

    def expression_end(self, i: int) -> int:
        """The place after the expression that starts at i: where a new line cannot continue it."""
        c = self.c
        first = True
        while c.kinds[i] != "end":
            text, kind = c.texts[i], c.kinds[i]
            if kind == "op" and text in (")", "]", "}", ",", ";"):
                if text == ";" and c.starts[i] == c.starts[i - 1]:
                    pass
                elif text == ";" and c.kinds[i + 1] == "str" and c.texts[i + 1] == '""':
                    i += 2
                    continue
                else:
                    return i
            if c.fresh[i] and not first:
                before, before_kind = c.texts[i - 1], c.kinds[i - 1]
                goes_on = (before_kind == "op" and before not in (")", "]", "}", "++", "--", "!!", ">", "?")) or before in ("else", "is", "in", "as", "return", "throw") or text in (".", "?.", "?:", "else", "&&", "||", "::", "as")
                if not goes_on and not (before == ")" and self.controls(i - 1)):
                    return i
            first = False
            i = c.past(i) if kind == "op" and text in OPENERS else i + 1
        return i

    def controls(self, close: int) -> bool:
        """Whether these brackets hold the condition of if, while or for."""
        opener = self.c.partner[close]
        return opener > 0 and self.c.texts[opener - 1] in ("if", "while", "for")

    def read_property(self, start: int, annotations: list[dict]):
        c = self.c
        keyword = c.texts[c.at]
        c.at += 1
        if c.is_("<") and (after := c.type_arguments(c.at)):
            c.at = after
        if c.is_("("):
            c.at = c.past(c.at)
            name = ""
        else:
            i = c.at
            while c.texts[i + 1] in (".", "<", "?") and c.kinds[i + 1] == "op":
                if c.texts[i + 1] == "<":
                    i = (c.type_arguments(i + 1) or i + 2) - 1
                elif c.texts[i + 1] == "?":
                    i += 1
                else:
                    i += 2
            name = c.texts[i]
            c.at = i + 1
        type_ = ""
        if c.take(":"):
            end = self.type_end(c.at, len(c.texts) - 1)
            type_ = c.text(c.at, end)
            c.at = end
        if c.is_("=", "by"):
            c.at = self.expression_end(c.at + 1)
        # Accessors.
        while True:
            back = c.at
            c.take(";")
            self.prefix()
            if c.is_("get", "set") and (c.is_("(", ahead=1) or c.fresh[c.at + 1] or c.is_("}", ahead=1)):
                c.at += 1
                if c.is_("(") and not c.fresh[c.at]:
                    c.at = c.past(c.at)
                    if c.take(":"):
                        c.at = self.type_end(c.at, len(c.texts) - 1)
                    self.body()
                continue
            c.at = back
            break
        return c.lines[start], annotations, name, f"{keyword} {type_}".strip()

    def read_constructor(self, start: int, annotations: list[dict]):
        c = self.c
        c.at += 1
        params = self.parameters(c.at)
        c.at = c.past(c.at)
        if c.take(":"):
            c.at += 1
            if c.is_("("):
                c.at = c.past(c.at)
        return c.lines[start], annotations, params, self.body() if c.is_("{") else None

    # --- rows ---

    def function(self, read, owner: str, row: dict) -> None:
        if read is None:
            return
        line, annotations, modifiers, name, receiver, params, returns, body = read
        sig = signature(name, params)
        id_ = f"{owner}.{sig}"
        self.add(id=id_, kind="METHOD", declaring_class_id=owner, name=name, signature=sig, return_type=returns, params=[{"name": p["name"], "type": p["type"]} for p in params], modifiers=modifiers, line=line, annotations=self.labels(annotations), raw_annotations=annotations, receiver_type=receiver, injection="METHOD", supertypes=[])
        row["method_ids"].append(id_)
        if body and self.sought:
            self.calls(id_, *body, {p["name"] for p in params if p["function"]})

    def constructor(self, read, owner: str, name: str, row: dict) -> None:
        line, annotations, params, body = read
        sig = signature(name, params)
        id_ = f"{owner}#{sig}"
        self.add(id=id_, kind="CONSTRUCTOR", declaring_class_id=owner, name=name, signature=sig, return_type=name, params=[{"name": p["name"], "type": p["type"]} for p in params], modifiers=[], line=line, annotations=self.labels(annotations), raw_annotations=annotations, receiver_type="", injection="CONSTRUCTOR", supertypes=[])
        row["method_ids"].append(id_)
        if body and self.sought:
            self.calls(id_, *body, set())

    def property(self, read, owner: str, row: dict) -> None:
        line, annotations, name, type_ = read
        if name:
            self.field(owner, name, type_, line, annotations, row)

    def field(self, owner: str, name: str, type_: str, line: int, annotations: list[dict], row: dict) -> None:
        id_ = f"{owner}#{name}"
        self.add(id=id_, kind="FIELD", declaring_class_id=owner, name=name, field_type=type_, line=line, annotations=self.labels(annotations), raw_annotations=annotations, injection="FIELD", supertypes=[])
        row["field_ids"].append(id_)

    # --- what bodies call ---

    def ends_value(self, i: int) -> bool:
        """Whether token i can end an operand."""
        text, kind = self.c.texts[i], self.c.kinds[i]
        if kind in ("num", "str"):
            return True
        if kind == "id":
            return text not in HARD or text in ("this", "super", "null", "true", "false")
        if text == ")":
            return not self.controls(i)
        return text in ("]", "}", "!!", "++", "--")

    def operand_start(self, i: int) -> int:
        """Where the chain of names, calls and indexes that ends with token i begins."""
        c = self.c
        while True:
            text, kind = c.texts[i], c.kinds[i]
            if text in (")", "]", "}") and kind == "op":
                i = c.partner[i]
                if i > 0 and not c.fresh[i] and (c.kinds[i - 1] == "id" and c.texts[i - 1] not in NOT_CALLED or c.texts[i - 1] in (")", "]")):
                    i -= 1
                    continue
            elif text in ("!!", "++", "--"):
                i -= 1
                continue
            if i > 0 and c.texts[i - 1] in (".", "?.", "::") and c.kinds[i - 1] == "op":
                i -= 2
                continue
            return i

    def site(self, caller: str, op: str, name: str, arity: int, i: int, j: int, receiver: str = "", lambda_param: bool = False) -> None:
        c = self.c
        self.sites.append({"caller_id": caller, "op": op, "name": name, "arity": arity, "receiver_text": receiver, "expr": c.text(i, j), "is_lambda_param": lambda_param, "file_path": self.path, "line": c.lines[i], "origin": "KOTLIN"})

    def arguments(self, at: int) -> tuple[int, int] | None:
        """How many arguments a call has whose callee ends before token `at`, and the place after it."""
        c, n, called = self.c, 0, False
        if c.texts[at] == "<" and c.kinds[at] == "op":
            after = c.type_arguments(at)
            if not after or c.texts[after] not in ("(", "{") or c.fresh[after]:
                return None
            at = after
        if c.texts[at] == "(" and c.kinds[at] == "op" and not c.fresh[at]:
            n += len(c.parts(at + 1, c.partner[at], angles=False))
            at, called = c.past(at), True
        if c.texts[at] == "{" and c.kinds[at] == "op" and not c.fresh[at]:
            n, at, called = n + 1, c.past(at), True
        return (n, at) if called else None

    def calls(self, caller: str, start: int, end: int, lambda_params: set[str]) -> None:
        c = self.c
        i = start
        while i < end:
            text, kind, before, before_kind = c.texts[i], c.kinds[i], c.texts[i - 1], c.kinds[i - 1]
            if kind == "id":
                declares = before in ("fun", "class", "interface", "object", "@", "val", "var", "::") and before_kind in ("id", "op")
                inherits = before == ":" and (c.texts[i - 2] == "object" or self.in_header(i - 1, start))
                if text not in NOT_CALLED and not declares and not inherits and not self.annotated(i, start) and (found := self.arguments(i + 1)):
                    block_only = c.texts[i + 1] == "{" and self.opens_body(i, start)
                    if not block_only and not (text in ("this", "super") and c.texts[i + 1] == "{"):
                        n, after = found
                        receiver = c.text(self.operand_start(i - 2), i - 1) if before == "." and i - 2 >= start else ""
                        self.site(caller, "CALL", text, n, i, after, receiver.strip(), text in lambda_params)
                i += 1
                continue
            if kind == "op":
                value = i > start and self.ends_value(i - 1)
                same_line = not c.fresh[i]
                if text in BINARY and value and (same_line or text not in ("+", "-")):
                    if text == "<" and self.is_type_list(i):
                        i = c.type_arguments(i)
                        continue
                    if not (text == "==" and c.texts[i + 1] == "="):
                        left = self.operand_start(i - 1)
                        self.site(caller, "BINARY", BINARY[text], 1, left, min(i + 2, end))
                elif text in ("++", "--") and value and same_line:
                    self.site(caller, "POSTFIX", UNARY[text], 0, self.operand_start(i - 1), i + 1)
                elif text in UNARY and c.kinds[i + 1] != "end" and not (text == "!" and c.texts[i + 1] in ("in", "is")):
                    self.site(caller, "PREFIX", UNARY[text], 0, i, min(i + 2, end))
                elif text == "[" and value and same_line:
                    close = c.partner[i]
                    n = len(c.parts(i + 1, close, angles=False))
                    write = c.texts[close + 1] == "=" and c.kinds[close + 1] == "op"
                    self.site(caller, "INDEX_SET" if write else "INDEX_GET", "set" if write else "get", n + write, self.operand_start(i - 1), close + 1)
            i += 1

    def is_type_list(self, i: int) -> bool:
        after = self.c.type_arguments(i)
        return bool(after) and self.c.texts[after] in ("(", "{", ".", "::", ")", ",", "=", ">") and self.c.kinds[i - 1] == "id"

    def annotated(self, i: int, start: int) -> bool:
        c = self.c
        while i - 2 >= start and c.texts[i - 1] == "." and c.kinds[i - 2] == "id":
            i -= 2
        return c.texts[i - 1] == "@" and c.kinds[i - 1] == "op"

    def in_header(self, colon: int, start: int) -> bool:
        """Whether this colon opens the supertypes of a local class or the type of a local function or value."""
        c, i = self.c, colon - 1
        while i > start and not c.fresh[i] and c.texts[i] not in ("{", ";"):
            if c.texts[i] in ("class", "object", "val", "var", "fun", "interface") and c.kinds[i] == "id":
                return True
            i = c.partner[i] - 1 if c.texts[i] == ")" and c.kinds[i] == "op" else i - 1
        return i > start and c.texts[i] in ("class", "object", "val", "var", "fun") and c.kinds[i] == "id"

    def opens_body(self, i: int, start: int) -> bool:
        """Whether `name {` ends the header of a local declaration instead of calling name with a lambda."""
        c = self.c
        before, before_kind = c.texts[i - 1], c.kinds[i - 1]
        return before in (":", "->", "is", "as", "as?") and before_kind in ("op", "id") and (before != "->")


def parse(path: str, source: str, calls: bool = True) -> tuple[list[dict], list[dict]]:
    """Symbols and call sites of one file, in order; bodies are not searched where calls are not wanted."""
    found = KotlinFile(path, source, calls).read()
    return found.symbols, found.sites

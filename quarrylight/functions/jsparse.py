"""A small parser of JavaScript (ES2022) for static analysis: text to a tree of Node.

A tokenizer that keeps line breaks and tells a regular expression from a
division by what stands before it, and an operator-precedence parser over its
tokens. Texts that are not programs raise Unparseable. Scope rules (such as a
name declared twice) are not checked.
"""

from __future__ import annotations

import re


class Unparseable(Exception):
    pass


class Node:
    """type, line, and by type: name, value, op, computed; kids are (slot, node) in walking order."""

    __slots__ = ("type", "line", "name", "value", "op", "computed", "kids", "quasis", "start", "paren")

    def __init__(self, type_: str, line: int, kids=(), name=None, value=None, op=None, computed=False, quasis=None) -> None:
        self.type, self.line, self.kids = type_, line, [(s, k) for s, k in kids if k is not None]
        self.name, self.value, self.op, self.computed, self.quasis, self.paren = name, value, op, computed, quasis, False

    def kid(self, slot: str) -> Node | None:
        return next((k for s, k in self.kids if s == slot), None)

    def many(self, slot: str) -> list[Node]:
        return [k for s, k in self.kids if s == slot]


RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof "
    "new null return super switch this throw true try typeof var void while with enum".split()
)
# a regular expression may follow these words
BEFORE_REGEX = frozenset("return typeof case do else in instanceof new void delete throw await yield of".split())
PUNCTUATORS = sorted(
    "{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... @".split(),
    key=len, reverse=True,
)
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_SPACE = re.compile(r"(?:[ \t\v\f\u00a0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]|//[^\n\r\u2028\u2029]*)+")
_BREAK = re.compile(r"\r\n|[\n\r\u2028\u2029]")
_NAME = re.compile(r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|\$|\u200c|\u200d|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
_PUNC = re.compile("|".join(re.escape(p) for p in PUNCTUATORS))
_REGEX = re.compile(r"/(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/\w*")
_STRING = re.compile(r"""'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*\"""")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\n\r\u2028\u2029])|([0-7]{1,3})|([\s\S]))")
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}


def _unescape(m: re.Match) -> str:
    for g in (1, 2, 3):
        if m[g]:
            n = int(m[g], 16)
            return chr(n) if n < 0x110000 else "\ufffd"
    if m[4]:
        return ""
    return chr(int(m[5], 8)) if m[5] else _SIMPLE.get(m[6], m[6])


class Token:
    __slots__ = ("kind", "text", "line", "fresh", "value", "parts")

    def __init__(self, kind, text, line, fresh, value=None, parts=None) -> None:
        self.kind, self.text, self.line, self.fresh, self.value, self.parts = kind, text, line, fresh, value, parts


class Lexer:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.line = text, 0, 1

    def tokens(self, inside: bool = False) -> list[Token]:
        """All tokens; inside a template, those up to the closing brace of a substitution."""
        text, out, fresh = self.text, [], False
        parens: list[bool] = []  # whether a regular expression may follow the closing parenthesis
        braces: list[bool] = []
        while True:
            if m := _SPACE.match(text, self.at):
                self.at = m.end()
            if m := _BREAK.match(text, self.at):
                self.at, self.line, fresh = m.end(), self.line + 1, True
                continue
            if text.startswith("/*", self.at):
                end = text.find("*/", self.at + 2)
                if end < 0:
                    raise Unparseable("comment")
                n = len(_BREAK.findall(text, self.at, end))
                self.line, fresh, self.at = self.line + n, fresh or n > 0, end + 2
                continue
            if self.at >= len(text):
                if inside:
                    raise Unparseable("template")
                out.append(Token("eof", "", self.line, fresh))
                return out
            if self.at == 0 and text.startswith("#!"):
                self.at = len(text.split("\n", 1)[0])
                continue
            line, c = self.line, text[self.at]
            last = out[-1] if out else None
            if c in "'\"":
                m = _STRING.match(text, self.at)
                if not m:
                    raise Unparseable("string")
                self.line += len(_BREAK.findall(m[0]))
                token = Token("str", m[0], line, fresh, _ESCAPE.sub(_unescape, m[0][1:-1]))
                self.at = m.end()
            elif c == "`":
                token = self.template(line, fresh)
            elif m := _NAME.match(text, self.at):
                name = _ESCAPE.sub(_unescape, m[0]) if "\\" in m[0] else m[0]
                token, self.at = Token("name", name, line, fresh), m.end()
            elif c == "#" and (m := _NAME.match(text, self.at + 1)):
                token, self.at = Token("private", m[0], line, fresh), m.end()
            elif (c.isdigit() or c == "." and text[self.at + 1 : self.at + 2].isdigit()) and (m := _NUMBER.match(text, self.at)):
                if _NAME.match(text, m.end()):
                    raise Unparseable("number")
                token, self.at = Token("num", m[0], line, fresh), m.end()
            elif c == "/" and self.regex_follows(out, last) and (m := _REGEX.match(text, self.at)):
                token, self.at = Token("re", m[0], line, fresh), m.end()
            elif m := _PUNC.match(text, self.at):
                p = m[0]
                if p == "?." and text[self.at + 2 : self.at + 3].isdigit():
                    p = "?"
                token, self.at = Token("punc", p, line, fresh), self.at + len(p)
                if p == "(":
                    parens.append(last is not None and last.kind == "name" and last.text in ("if", "while", "for", "with"))
                elif p == ")":
                    token.value = parens.pop() if parens else False
                elif p == "{":
                    braces.append(not self.value_expected(last))
                elif p == "}":
                    if inside and not braces:
                        out.append(Token("eof", "", line, fresh))
                        return out
                    token.value = braces.pop() if braces else True
            else:
                raise Unparseable(f"character {c!r}")
            out.append(token)
            fresh = False

    @staticmethod
    def value_expected(last: Token | None) -> bool:
        """Whether what follows is a value (so that a brace opens an object, not a block)."""
        if last is None:
            return False
        if last.kind == "punc":
            return last.text not in (")", "]", "}", ";", "{", "=>")
        return last.kind == "name" and last.text in BEFORE_REGEX - {"do", "else"}

    @staticmethod
    def regex_follows(out: list[Token], last: Token | None) -> bool:
        if last is None:
            return True
        if last.kind == "punc":
            if last.text in (")", "}"):
                return bool(last.value)
            return last.text not in ("]", "++", "--")
        member = len(out) > 1 and out[-2].kind == "punc" and out[-2].text in (".", "?.")
        return last.kind == "name" and last.text in BEFORE_REGEX and not member

    def template(self, line: int, fresh: bool) -> Token:
        text, quasis, parts = self.text, [], []
        self.at += 1
        start = self.at
        while True:
            if self.at >= len(text):
                raise Unparseable("template")
            c = text[self.at]
            if c == "\\":
                self.at += 2
            elif c == "`":
                quasis.append(text[start : self.at].replace("\r\n", "\n"))
                self.at += 1
                return Token("tmpl", "`", line, fresh, quasis, parts)
            elif text.startswith("${", self.at):
                quasis.append(text[start : self.at].replace("\r\n", "\n"))
                self.at += 2
                parts.append(self.tokens(inside=True))
                start = self.at
            else:
                if c == "\n":
                    self.line += 1
                self.at += 1


class Parser:
    def __init__(self, tokens: list[Token]) -> None:
        self.toks, self.i, self.uses_with = tokens, 0, False
        self.closing: dict[int, int] | None = None

    # tokens
    @property
    def t(self) -> Token:
        return self.toks[self.i]

    def next(self) -> Token:
        t = self.toks[self.i]
        if t.kind != "eof":
            self.i += 1
        return t

    def at_punc(self, *texts: str) -> bool:
        t = self.toks[self.i]
        return t.kind == "punc" and t.text in texts

    def at_name(self, *texts: str) -> bool:
        t = self.toks[self.i]
        return t.kind == "name" and t.text in texts

    def ahead(self, n: int = 1) -> Token:
        return self.toks[min(self.i + n, len(self.toks) - 1)]

    def eat(self, text: str) -> bool:
        t = self.toks[self.i]
        if t.text == text and t.kind in ("punc", "name"):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> Token:
        t = self.t
        if not self.eat(text):
            raise Unparseable(f"line {t.line}: {text} expected, {t.text!r} found")
        return t

    def end_statement(self) -> None:
        if self.eat(";") or self.at_punc("}") or self.t.kind == "eof" or self.t.fresh:
            return
        raise Unparseable(f"line {self.t.line}: unexpected {self.t.text!r}")

    def matching(self, at: int) -> int:
        """Number of the parenthesis token that closes the one at `at`."""
        if self.closing is None:
            self.closing, open_ = {}, []
            for k, t in enumerate(self.toks):
                if t.kind == "punc" and t.text in ("(", "[", "{"):
                    open_.append(k)
                elif t.kind == "punc" and t.text in (")", "]", "}") and open_:
                    self.closing[open_.pop()] = k
        return self.closing.get(at, len(self.toks) - 1)

    # statements
    def program(self) -> Node:
        body = []
        while self.t.kind != "eof":
            body.append(("body", self.statement()))
        return Node("Program", 1, body)

    def block(self) -> Node:
        line = self.need("{").line
        body = []
        while not self.at_punc("}"):
            if self.t.kind == "eof":
                raise Unparseable("block")
            body.append(("body", self.statement()))
        self.next()
        return Node("BlockStatement", line, body)

    def in_parens(self) -> Node:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def statement(self) -> Node:
        t = self.t
        line = t.line
        if t.kind == "punc":
            if t.text == "{":
                return self.block()
            if t.text == ";":
                self.next()
                return Node("EmptyStatement", line)
        if t.kind == "name":
            follow = self.ahead()
            colon = follow.kind == "punc" and follow.text == ":"
            if t.text not in RESERVED and colon:
                self.i += 2
                return Node("LabeledStatement", line, [("body", self.statement()), ("label", Node("Identifier", line, name=t.text))])
            handler = getattr(self, f"s_{t.text}", None) if t.text in STATEMENTS else None
            if t.text == "let" and not (follow.kind == "name" and follow.text not in ("in", "instanceof", "of") or follow.kind == "punc" and follow.text in ("[", "{")):
                handler = None
            if t.text == "async":
                handler = self.s_function if follow.kind == "name" and follow.text == "function" and not follow.fresh else None
            if t.text == "import" and follow.kind == "punc" and follow.text in ("(", "."):
                handler = None
            if handler:
                return handler()
        e = self.expression()
        self.end_statement()
        return Node("ExpressionStatement", line, [("expression", e)])

    def s_var(self, end: bool = True, no_in: bool = False) -> Node:
        t = self.next()
        out = []
        while True:
            line = self.t.line
            target = self.binding()
            init = self.assignment(no_in) if self.eat("=") else None
            out.append(("declarations", Node("VariableDeclarator", line, [("id", target), ("init", init)])))
            if not self.eat(","):
                break
        if end:
            bare = any(d.kid("init") is None and (t.text == "const" or d.kid("id").type != "Identifier") for _, d in out)
            if bare:
                raise Unparseable(f"line {t.line}: declaration without a value")
            self.end_statement()
        return Node("VariableDeclaration", t.line, out, op=t.text)

    s_let = s_const = s_var

    def s_function(self) -> Node:
        return self.function(statement=True)

    def s_class(self) -> Node:
        return self.class_(statement=True)

    def s_if(self) -> Node:
        line = self.next().line
        test, then = self.in_parens(), self.statement()
        return Node("IfStatement", line, [("test", test), ("consequent", then), ("alternate", self.statement() if self.eat("else") else None)])

    def s_for(self) -> Node:
        line = self.next().line
        self.eat("await")
        self.need("(")
        init = None
        if not self.at_punc(";"):
            if self.at_name("var", "const") or self.at_name("let") and self.ahead().text not in ("in", "of", ";"):
                init = self.s_var(end=False, no_in=True)
            else:
                init = self.expression(no_in=True)
            if self.at_name("of", "in"):
                of = self.next().text == "of"
                if init.type == "VariableDeclaration" and len(init.kids) != 1:
                    raise Unparseable("for")
                right = self.assignment() if of else self.expression()
                self.need(")")
                return Node("ForOfStatement" if of else "ForInStatement", line, [("left", init), ("right", right), ("body", self.statement())])
        self.need(";")
        test = None if self.at_punc(";") else self.expression()
        self.need(";")
        update = None if self.at_punc(")") else self.expression()
        self.need(")")
        return Node("ForStatement", line, [("init", init), ("test", test), ("update", update), ("body", self.statement())])

    def s_while(self) -> Node:
        line = self.next().line
        test = self.in_parens()
        return Node("WhileStatement", line, [("test", test), ("body", self.statement())])

    def s_do(self) -> Node:
        line = self.next().line
        body = self.statement()
        self.need("while")
        test = self.in_parens()
        self.eat(";")
        return Node("DoWhileStatement", line, [("body", body), ("test", test)])

    def s_return(self) -> Node:
        t = self.next()
        e = None if self.at_punc(";", "}") or self.t.kind == "eof" or self.t.fresh else self.expression()
        self.end_statement()
        return Node("ReturnStatement", t.line, [("argument", e)])

    def s_throw(self) -> Node:
        t = self.next()
        if self.t.fresh:
            raise Unparseable("throw")
        e = self.expression()
        self.end_statement()
        return Node("ThrowStatement", t.line, [("argument", e)])

    def s_break(self) -> Node:
        t = self.next()
        if self.t.kind == "name" and not self.t.fresh and self.t.text not in RESERVED:
            self.next()
        self.end_statement()
        return Node("BreakStatement" if t.text == "break" else "ContinueStatement", t.line)

    s_continue = s_break

    def s_debugger(self) -> Node:
        line = self.next().line
        self.end_statement()
        return Node("DebuggerStatement", line)

    def s_with(self) -> Node:
        line = self.next().line
        self.uses_with = True
        e = self.in_parens()
        return Node("WithStatement", line, [("object", e), ("body", self.statement())])

    def s_try(self) -> Node:
        line = self.next().line
        kids = [("block", self.block())]
        if self.at_name("catch"):
            at = self.next().line
            param = None
            if self.eat("("):
                param = self.binding()
                self.need(")")
            kids.append(("handler", Node("CatchClause", at, [("param", param), ("body", self.block())])))
        if self.eat("finally"):
            kids.append(("finalizer", self.block()))
        if len(kids) == 1:
            raise Unparseable("try")
        return Node("TryStatement", line, kids)

    def s_switch(self) -> Node:
        line = self.next().line
        kids = [("discriminant", self.in_parens())]
        self.need("{")
        while not self.eat("}"):
            at = self.t.line
            test = None
            if self.eat("case"):
                test = self.expression()
            else:
                self.need("default")
            self.need(":")
            body = []
            while not self.at_name("case", "default") and not self.at_punc("}"):
                if self.t.kind == "eof":
                    raise Unparseable("switch")
                body.append(("consequent", self.statement()))
            kids.append(("cases", Node("SwitchCase", at, [*body, ("test", test)])))
        return Node("SwitchStatement", line, kids)

    def module_name(self) -> None:
        if self.t.kind not in ("name", "str"):
            raise Unparseable(f"line {self.t.line}: name expected")
        self.next()

    def specifiers(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.module_name()
            if self.eat("as"):
                self.module_name()
            if not self.at_punc("}"):
                self.need(",")

    def source(self) -> Node:
        t = self.next()
        if t.kind != "str":
            raise Unparseable(f"line {t.line}: module name expected")
        return Node("Literal", t.line, value=t.value)

    def s_import(self) -> Node:
        line = self.next().line
        if self.t.kind != "str":
            if self.t.kind == "name":
                self.next()
                if self.eat(",") and not self.at_punc("{", "*"):
                    raise Unparseable("import")
            if self.eat("*"):
                self.need("as")
                self.module_name()
            elif self.at_punc("{"):
                self.specifiers()
            self.need("from")
        source = self.source()
        self.end_statement()
        return Node("ImportDeclaration", line, [("source", source)])

    def s_export(self) -> Node:
        line = self.next().line
        if self.eat("default"):
            if self.at_name("function") or self.at_name("async") and self.ahead().text == "function":
                d = self.function(statement=True, named=False)
            elif self.at_name("class"):
                d = self.class_(statement=True, named=False)
            else:
                d = self.assignment()
                self.end_statement()
            return Node("ExportDefaultDeclaration", line, [("declaration", d)])
        if self.eat("*"):
            if self.eat("as"):
                self.module_name()
            self.need("from")
            source = self.source()
            self.end_statement()
            return Node("ExportAllDeclaration", line, [("source", source)])
        if self.at_punc("{"):
            self.specifiers()
            source = self.source() if self.eat("from") else None
            self.end_statement()
            return Node("ExportNamedDeclaration", line, [("source", source)])
        d = self.statement()
        if d.type not in ("VariableDeclaration", "FunctionDeclaration", "ClassDeclaration"):
            raise Unparseable("export")
        return Node("ExportNamedDeclaration", line, [("declaration", d)])

    # patterns, functions and classes
    def binding(self) -> Node:
        t = self.t
        if t.kind == "name" and t.text not in RESERVED:
            self.next()
            return Node("Identifier", t.line, name=t.text)
        if self.at_punc("["):
            self.next()
            kids = []
            while not self.eat("]"):
                if self.eat(","):
                    continue
                rest = self.eat("...")
                target = self.with_default()
                kids.append(("elements", Node("RestElement", t.line, [("argument", target)]) if rest else target))
                if not self.at_punc("]"):
                    self.need(",")
            return Node("ArrayPattern", t.line, kids)
        if self.at_punc("{"):
            self.next()
            kids = []
            while not self.eat("}"):
                if self.eat("..."):
                    kids.append(("properties", Node("RestElement", t.line, [("argument", self.binding())])))
                else:
                    key, computed = self.key()
                    value = self.with_default() if self.eat(":") else key
                    if value is key and self.eat("="):
                        value = Node("AssignmentPattern", key.line, [("left", key), ("right", self.assignment())])
                    kids.append(("properties", Node("Property", key.line, [("key", key), ("value", value)], computed=computed)))
                if not self.at_punc("}"):
                    self.need(",")
            return Node("ObjectPattern", t.line, kids)
        raise Unparseable(f"line {t.line}: unexpected {t.text!r}")

    def with_default(self) -> Node:
        target = self.binding()
        if self.eat("="):
            return Node("AssignmentPattern", target.line, [("left", target), ("right", self.assignment())])
        return target

    def params(self) -> list[tuple[str, Node]]:
        self.need("(")
        out = []
        while not self.eat(")"):
            rest, line = self.eat("..."), self.t.line
            target = self.with_default()
            out.append(("params", Node("RestElement", line, [("argument", target)]) if rest else target))
            if not self.at_punc(")"):
                self.need(",")
        return out

    def function(self, statement: bool = False, named: bool = True) -> Node:
        line = self.t.line
        self.eat("async")
        self.need("function")
        self.eat("*")
        name = None
        if self.t.kind == "name":
            name = self.binding()
        elif statement and named:
            raise Unparseable("function name")
        return Node("FunctionDeclaration" if statement else "FunctionExpression", line, [("id", name), *self.params(), ("body", self.block())])

    def method(self) -> Node:
        line = self.t.line
        return Node("FunctionExpression", line, [*self.params(), ("body", self.block())])

    def class_(self, statement: bool = False, named: bool = True) -> Node:
        line = self.need("class").line
        name = self.binding() if self.t.kind == "name" and self.t.text != "extends" else None
        if statement and named and name is None:
            raise Unparseable("class name")
        base = self.subscripts(self.primary()) if self.eat("extends") else None
        at = self.need("{").line
        body = []
        while not self.eat("}"):
            if self.eat(";"):
                continue
            body.append(("body", self.member()))
        return Node("ClassDeclaration" if statement else "ClassExpression", line, [("id", name), ("superClass", base), ("body", Node("ClassBody", at, body))])

    def modifier(self, *words: str) -> bool:
        """Take a modifier such as static or get, unless it is itself the name of the member."""
        if self.at_name(*words) and not (self.ahead().kind == "punc" and self.ahead().text in ("(", "=", ";", "}", ",", ":")):
            self.next()
            return True
        return False

    def member(self) -> Node:
        line = self.t.line
        if self.at_name("static") and self.ahead().text == "{" and self.ahead().kind == "punc":
            self.next()
            return Node("StaticBlock", line, [("body", self.block())])
        self.modifier("static")
        self.modifier("async") or self.modifier("get", "set")
        self.eat("*")
        key, computed = self.key(private=True)
        if self.at_punc("("):
            return Node("MethodDefinition", line, [("key", key), ("value", self.method())], computed=computed)
        value = self.assignment() if self.eat("=") else None
        self.end_statement()
        return Node("PropertyDefinition", line, [("key", key), ("value", value)], computed=computed)

    def key(self, private: bool = False) -> tuple[Node, bool]:
        t = self.next()
        if t.kind == "name" or private and t.kind == "private":
            return Node("Identifier" if t.kind == "name" else "PrivateIdentifier", t.line, name=t.text), False
        if t.kind == "str":
            return Node("Literal", t.line, value=t.value), False
        if t.kind == "num":
            return Node("Literal", t.line, value=number(t.text)), False
        if t.kind == "punc" and t.text == "[":
            e = self.assignment()
            self.need("]")
            return e, True
        raise Unparseable(f"line {t.line}: unexpected {t.text!r}")

    # expressions
    def expression(self, no_in: bool = False) -> Node:
        line = self.t.line
        e = self.assignment(no_in)
        if not self.at_punc(","):
            return e
        parts = [e]
        while self.eat(","):
            parts.append(self.assignment(no_in))
        return Node("SequenceExpression", line, [("expressions", x) for x in parts])

    def is_arrow(self) -> bool:
        t = self.t
        k = self.i + (1 if t.kind == "name" and t.text == "async" and self.ahead().kind in ("punc", "name") and not self.ahead().fresh and self.ahead().text != "=>" else 0)
        u = self.toks[k]
        if u.kind == "name" and u.text not in RESERVED:
            after = self.toks[min(k + 1, len(self.toks) - 1)]
        elif u.kind == "punc" and u.text == "(":
            after = self.toks[min(self.matching(k) + 1, len(self.toks) - 1)]
        else:
            return False
        return after.kind == "punc" and after.text == "=>" and not after.fresh

    def arrow(self, no_in: bool) -> Node:
        line = self.t.line
        if self.at_name("async") and self.ahead().text != "=>":
            self.next()
        params = self.params() if self.at_punc("(") else [("params", self.binding())]
        self.need("=>")
        body = self.block() if self.at_punc("{") else self.assignment(no_in)
        return Node("ArrowFunctionExpression", line, [*params, ("body", body)])

    def assignment(self, no_in: bool = False) -> Node:
        line = self.t.line
        if self.is_arrow():
            return self.arrow(no_in)
        if self.at_name("yield") and self.in_yield():
            self.next()
            self.eat("*")
            bare = self.t.fresh or self.t.kind == "eof" or self.at_punc(")", "]", "}", ",", ";", ":")
            return Node("YieldExpression", line, [("argument", None if bare else self.assignment(no_in))])
        left = self.conditional(no_in)
        if self.t.kind == "punc" and self.t.text in ASSIGN:
            op = self.next().text
            targets = ("Identifier", "MemberExpression") if op != "=" else ("Identifier", "MemberExpression", "ObjectExpression", "ArrayExpression")
            if left.type not in targets:
                raise Unparseable(f"line {line}: assignment to {left.type}")
            kind = {"ObjectExpression": "ObjectPattern", "ArrayExpression": "ArrayPattern"}.get(left.type, left.type)
            left.type = kind
            return Node("AssignmentExpression", line, [("left", left), ("right", self.assignment(no_in))], op=op)
        return left

    def in_yield(self) -> bool:
        n = self.ahead()
        return not (n.kind == "punc" and n.text in ("=", ".", "=>"))

    def conditional(self, no_in: bool) -> Node:
        line = self.t.line
        test = self.binary(self.unary(), 0, no_in)
        if not self.eat("?"):
            return test
        then = self.assignment()
        self.need(":")
        return Node("ConditionalExpression", line, [("test", test), ("consequent", then), ("alternate", self.assignment(no_in))])

    def binary(self, left: Node, least: int, no_in: bool) -> Node:
        while True:
            t = self.t
            power = BINARY.get(t.text, 0) if t.kind == "punc" or t.kind == "name" and t.text in ("in", "instanceof") else 0
            if power <= least or no_in and t.text == "in":
                return left
            self.next()
            right = self.binary(self.unary(), power - 1 if t.text == "**" else power, no_in)
            kind = "LogicalExpression" if t.text in ("&&", "||", "??") else "BinaryExpression"
            left = Node(kind, left.line, [("left", left), ("right", right)], op=t.text)

    def unary(self) -> Node:
        t = self.t
        if t.kind == "punc" and t.text in ("!", "~", "+", "-") or t.kind == "name" and t.text in ("typeof", "void", "delete"):
            self.next()
            return Node("UnaryExpression", t.line, [("argument", self.unary())], op=t.text)
        if t.kind == "punc" and t.text in ("++", "--"):
            self.next()
            e = self.unary()
            if e.type not in ("Identifier", "MemberExpression"):
                raise Unparseable(f"line {t.line}: {t.text}")
            return Node("UpdateExpression", t.line, [("argument", e)], op=t.text)
        if t.kind == "name" and t.text == "await" and not (self.ahead().kind == "punc" and self.ahead().text in (")", ";", ",", "=", ".", "}", "=>")) and self.ahead().kind != "eof":
            self.next()
            return Node("AwaitExpression", t.line, [("argument", self.unary())])
        e = self.subscripts(self.primary())
        if self.at_punc("++", "--") and not self.t.fresh:
            if e.type not in ("Identifier", "MemberExpression"):
                raise Unparseable(f"line {t.line}: {self.t.text}")
            return Node("UpdateExpression", t.line, [("argument", e)], op=self.next().text)
        return e

    def arguments(self) -> list[tuple[str, Node]]:
        self.need("(")
        out = []
        while not self.eat(")"):
            line = self.t.line
            spread = self.eat("...")
            e = self.assignment()
            out.append(("arguments", Node("SpreadElement", line, [("argument", e)]) if spread else e))
            if not self.at_punc(")"):
                self.need(",")
        return out

    def property_name(self) -> Node:
        t = self.next()
        if t.kind not in ("name", "private"):
            raise Unparseable(f"line {t.line}: name expected, {t.text!r} found")
        return Node("Identifier" if t.kind == "name" else "PrivateIdentifier", t.line, name=t.text)

    def subscripts(self, e: Node, calls: bool = True) -> Node:
        line, chained = e.line, False
        while True:
            if self.at_punc("?.") and calls:
                self.next()
                chained = True
                if self.at_punc("("):
                    e = Node("CallExpression", line, [("callee", e), *self.arguments()])
                elif self.eat("["):
                    e = Node("MemberExpression", line, [("object", e), ("property", self.expression())], computed=True)
                    self.need("]")
                else:
                    e = Node("MemberExpression", line, [("object", e), ("property", self.property_name())])
            elif self.eat("."):
                e = Node("MemberExpression", line, [("object", e), ("property", self.property_name())])
            elif self.at_punc("["):
                self.next()
                e = Node("MemberExpression", line, [("object", e), ("property", self.expression())], computed=True)
                self.need("]")
            elif self.at_punc("(") and calls:
                if e.type == "Import":
                    e = Node("ImportExpression", line, [("source" if k == 0 else "options", a) for k, (_, a) in enumerate(self.arguments())])
                else:
                    e = Node("CallExpression", line, [("callee", e), *self.arguments()])
            elif self.t.kind == "tmpl":
                e = Node("TaggedTemplateExpression", line, [("tag", e), ("quasi", self.template(self.next()))])
            else:
                return Node("ChainExpression", line, [("expression", e)]) if chained else e

    def template(self, t: Token) -> Node:
        kids = []
        for part in t.parts:
            inner = Parser(part)
            e = inner.expression()
            if inner.t.kind != "eof":
                raise Unparseable("template")
            kids.append(("expressions", e))
        return Node("TemplateLiteral", t.line, kids, quasis=t.value)

    def primary(self) -> Node:
        t = self.next()
        line = t.line
        if t.kind == "str":
            return Node("Literal", line, value=t.value)
        if t.kind == "num":
            return Node("Literal", line, value=number(t.text))
        if t.kind == "re":
            return Node("Literal", line)
        if t.kind == "tmpl":
            return self.template(t)
        if t.kind == "private" and self.at_name("in"):
            return Node("PrivateIdentifier", line, name=t.text)
        if t.kind == "name":
            if t.text not in RESERVED:
                if t.text == "async" and self.at_name("function") and not self.t.fresh:
                    self.i -= 1
                    return self.function()
                return Node("Identifier", line, name=t.text)
            if t.text in ("this", "super"):
                return Node("ThisExpression" if t.text == "this" else "Super", line)
            if t.text in ("true", "false", "null"):
                return Node("Literal", line, value={"true": True, "false": False, "null": None}[t.text])
            if t.text in ("function", "class"):
                self.i -= 1
                return self.function() if t.text == "function" else self.class_()
            if t.text == "new":
                if self.eat("."):
                    self.need("target")
                    return Node("MetaProperty", line)
                callee = self.subscripts(self.primary(), calls=False)
                return Node("NewExpression", line, [("callee", callee), *(self.arguments() if self.at_punc("(") else [])])
            if t.text == "import":
                if self.eat("."):
                    self.need("meta")
                    return Node("MetaProperty", line)
                if self.at_punc("("):
                    return Node("Import", line)
        if t.kind == "punc":
            if t.text == "(":
                e = self.expression()
                self.need(")")
                e.paren = True
                return e
            if t.text == "[":
                kids = []
                while not self.eat("]"):
                    if self.eat(","):
                        continue
                    at, spread = self.t.line, self.eat("...")
                    e = self.assignment()
                    kids.append(("elements", Node("SpreadElement", at, [("argument", e)]) if spread else e))
                    if not self.at_punc("]"):
                        self.need(",")
                return Node("ArrayExpression", line, kids)
            if t.text == "{":
                return self.object_(line)
        raise Unparseable(f"line {line}: unexpected {t.text!r}")

    def object_(self, line: int) -> Node:
        kids = []
        while not self.eat("}"):
            at = self.t.line
            if self.eat("..."):
                kids.append(("properties", Node("SpreadElement", at, [("argument", self.assignment())])))
            else:
                self.modifier("async") or self.modifier("get", "set")
                star = self.eat("*")
                kind = self.t.kind
                key, computed = self.key()
                if self.at_punc("("):
                    value = self.method()
                elif not star and self.eat(":"):
                    value = self.assignment()
                elif kind == "name" and not computed and key.name not in RESERVED:
                    value = Node("Identifier", at, name=key.name)
                    if self.eat("="):  # a pattern with a default
                        value = Node("AssignmentPattern", at, [("left", value), ("right", self.assignment())])
                else:
                    raise Unparseable(f"line {at}: property")
                kids.append(("properties", Node("Property", at, [("key", key), ("value", value)], computed=computed)))
            if not self.at_punc("}"):
                self.need(",")
        return Node("ObjectExpression", line, kids)


STATEMENTS = frozenset("var let const function class if for while do return throw break continue debugger with try switch import export async".split())


def number(text: str) -> float | int:
    t = text.replace("_", "").rstrip("n")
    try:
        return int(t, 0) if t[:2].lower() in ("0x", "0o", "0b") else int(t) if t.isdigit() else float(t)
    except ValueError:
        return 0


def parse(text: str) -> tuple[Node, bool]:
    """(program, whether it can be a module: it has no with statement)."""
    p = Parser(Lexer(text).tokens())
    try:
        return p.program(), not p.uses_with
    except RecursionError as e:
        raise Unparseable("nesting") from e


def dotted(n: Node | None) -> str | None:
    """Name of an identifier or member chain; parts that aren't names are left out."""
    parts = []
    while n is not None and n.type == "MemberExpression":  # chains may be longer than a stack is deep
        parts.append(property_of(n))
        n = n.kid("object")
    parts.append(n.name if n is not None and n.type == "Identifier" else None)
    return ".".join(p for p in reversed(parts) if p) or None


def property_of(n: Node) -> str | None:
    p = n.kid("property")
    if p.name:
        return p.name
    return (p.value if isinstance(p.value, str) else str(p.value)) if p.type == "Literal" and p.value else None


def text_of(n: Node | None) -> str | None:
    """The text of a literal; of a template with * for what is put in; of a sum as far as it is known."""
    if n is None:
        return None
    if n.type == "Literal":
        return n.value if isinstance(n.value, str) else None
    if n.type == "TemplateLiteral":
        return "*".join(n.quasis)
    return "".join(sum_parts(n)[1]) or None if is_sum(n) else None


def is_sum(n: Node) -> bool:
    return n.type == "BinaryExpression" and n.op == "+"


def sum_parts(n: Node) -> tuple[list[Node], list[str]]:
    """The sums along the left side of a sum, and its known texts: sums[i] has the first len(texts) - i of them.

    Sums lean left, so a chain of terms takes one walk down.
    """
    sums, texts = [], []
    while is_sum(n):
        sums.append(n)
        texts.append(text_of(n.kid("right")) or "")
        n = n.kid("left")
    texts.append(text_of(n) or "")
    return sums, texts[::-1]


def walk(root: Node):
    """All nodes, parents before children, children in order, as (node, parent, slot)."""
    stack = [(root, None, "")]
    while stack:
        n, parent, slot = stack.pop()
        yield n, parent, slot
        stack.extend((k, n, s) for s, k in reversed(n.kids))

"""Tokens of TypeScript, scanned on demand: whether a slash starts a regular expression depends on the parser's place."""

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, number, string, template, regex, punct, end
    text: str
    start: int
    end: int
    newline: bool  # a line break stands before it
    comment: bool  # a comment stands before it


_BLANK = re.compile(r"(?:[\s﻿]+|//[^\n\r]*|/\*.*?(?:\*/|\Z)|\A#![^\n]*|<!--[^\n]*)+", re.DOTALL)
_NAME = re.compile(r"(?:[\w$]|[^\x00-\x7f\s]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})+|[#@](?=[\w$])")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
_STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'?|\"(?:[^\"\\\n]|\\.)*\"?", re.DOTALL)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*")
_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")


class Lexer:
    def __init__(self, code: str):
        self.code = code
        self.known: dict[tuple[int, bool], Token] = {}

    def scan(self, at: int, operand: bool) -> Token:
        """The token at or after a place; with ``operand`` a slash starts a regular expression."""
        key = at, operand
        if (known := self.known.get(key)) is not None:
            return known
        token = self._scan(at, operand)
        if len(self.known) > 4096:
            self.known.clear()
        self.known[key] = token
        return token

    def _scan(self, at: int, operand: bool) -> Token:
        code = self.code
        newline = comment = False
        if m := _BLANK.match(code, at):
            blank = m[0]
            newline, comment, at = "\n" in blank, "//" in blank or "/*" in blank, m.end()
        if at >= len(code):
            return Token("end", "", len(code), len(code), newline, comment)
        c = code[at]
        if c.isdigit() or c == "." and code[at + 1 : at + 2].isdigit():
            m = _NUMBER.match(code, at)
            return Token("number", m[0], at, m.end(), newline, comment)
        if c in "'\"":
            m = _STRING.match(code, at)
            return Token("string", m[0], at, m.end(), newline, comment)
        if c == "`":
            return Token("template", "`", at, at + 1, newline, comment)
        if c == "/" and operand and (m := _REGEX.match(code, at)):
            return Token("regex", m[0], at, m.end(), newline, comment)
        if c not in "@#" and (m := _NAME.match(code, at)):
            return Token("name", m[0], at, m.end(), newline, comment)
        if c == "#" and (m := re.compile(r"#[\w$]+").match(code, at)):
            return Token("name", m[0], at, m.end(), newline, comment)
        if m := _PUNCT.match(code, at):
            return Token("punct", m[0], at, m.end(), newline, comment)
        return Token("punct", c, at, at + 1, newline, comment)

"""Lexical rules and grammars of the languages. Precedence doesn't matter to a recogniser, so expressions are flat."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from siltstone.llm.gll import Grammar, Recogniser

NL = "\n"
ID, NUM, STR = "i", "n", "s"
BAD = "\x02"
#: A line end of Python before a line indented by so many columns, up to MOST_INDENT.
INDENT, INDENT0, MOST_INDENT = "\U00020000-\U000effff", 0x20000, 0xCFFFF
#: Stands for a JSX element in a text; its expressions follow in parentheses (see syntax.plain).
JSX = "\x03"


@dataclass
class Language:
    name: str
    keywords: str
    operators: str
    lexer: str  #: pattern of a token; comments and blanks are tokens, too
    grammar: str
    start: str
    sets: dict[str, str] = field(default_factory=dict)  #: name of a set -> its tokens, by blanks
    lists: dict[str, tuple[str, str]] = field(default_factory=dict)
    newlines: str = ""  #: "" they don't count; "asi" as in JavaScript; "go"; "py"
    soft: str = ""  #: keywords that are names as well

    def __post_init__(self) -> None:
        self.tokens = {t: t if t in "()[]{}" else chr(0xE000 + i) for i, t in enumerate(dict.fromkeys([*"()[]{}", *self.keywords.split(), *self.operators.split()]))}
        self.tokens["NL"] = NL
        names = {k: "".join({"ID": ID, "NUM": NUM, "STR": STR}.get(t) or self.tokens[t] for t in v.split()) for k, v in self.sets.items()}
        soft = "".join(self.tokens[t] for t in self.soft.split())
        every = "".join(self.tokens[t] for t in self.keywords.split())
        names |= {"ID": ID + soft, "NUM": NUM, "STR": STR, "NL": NL, "ANY": ID + every}
        g = Grammar(self.grammar, self.tokens, names)
        stay = "\U000f0000-\U000fffff" + "".join(re.escape(self.tokens[t]) for t in STAY.split() if t in self.tokens)
        sub = {k: (re.sub(r"<([^>]+)>", lambda m: re.escape(self.tokens[m[1]]), p).replace("STAY", stay), r) for k, (p, r) in self.lists.items()}
        self.r = Recogniser(g, sub)
        if self.newlines in ("asi", "py"):
            self.r.left_out, self.r.left_out_all = (NL, False) if self.newlines == "asi" else (f"[{INDENT}]+", True)
        self.lex = re.compile(self.lexer).findall
        self.kinds = Kinds(self)


class Kinds(dict):
    """The character of each token; what isn't known is judged by Language.kind, and kept if tokens like it come back."""

    def __init__(self, language: Language) -> None:
        super().__init__({t: c for t, c in language.tokens.items() if t not in ("NL", "`", "JSX")})
        if "JSX" in language.tokens:
            self[JSX] = language.tokens["JSX"]
        self.language = language

    def __missing__(self, t: str) -> str:
        c, keep = kind(self.language, t)
        if keep:
            if len(self) > KEPT_TOKENS:
                self.clear()
                self.__init__(self.language)
            self[t] = c
        return c


KEPT_TOKENS = 100_000
SUFFIX = {"javascript": "n", "typescript": "n", "java": "lLfFdD", "go": "ip", "rust": "", "c": "uUlLfFjJ", "json": "", "python": "jJ"}
_number_end = {k: re.compile(rf"(?:0[xX][0-9a-fA-F_.]*(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|[\d_.]+(?:[eE][+-]?\d[\d_]*)?)[{v}]*\Z" if v else r"[\s\S]*") for k, v in SUFFIX.items()}


def columns(blanks: str) -> int:
    """The column behind the blanks at the start of a line, with tab stops of eight."""
    w = 0
    for x in blanks:
        w = w // 8 * 8 + 8 if x == "\t" else 0 if x == "\f" else w + 1
    return w


def kind(lang: Language, t: str) -> tuple[str, bool]:
    """(the character of a token that isn't known yet, whether it is worth keeping)."""
    c = t[0]
    if c == "\n":
        return (chr(INDENT0 + columns(t[1:])) if lang.newlines == "py" else "\n" if lang.newlines else ""), True
    if c.isspace() or c == "\ufeff":
        return "", len(t) < 100
    if c == "\\" and len(t) > 1 and lang.name in ("python", "c"):
        return "", True
    if lang.name == "python" and c == "#" or lang.name == "c" and t.lstrip()[:1] == "#" or t[:2] == "#!" and len(t) > 2 and lang.name in ("javascript", "typescript"):
        return "", False
    if lang.name not in ("python", "json") and t[:2] in ("//", "/*") and len(t) > 1:
        return BAD if t == "/*" else "\n" if lang.newlines and "\n" in t else "", False
    if c == "`" and len(t) > 1 and "`" in lang.tokens:
        return lang.tokens["`"], False
    if t[-1] in "\"'`" and len(t) > 1 or c == "/" and len(t) > 1 or lang.name == "rust" and t[-1] == "#" and len(t) > 2:
        return STR, False
    if lang.name == "rust" and c == "'" and len(t) > 1:
        return lang.tokens["'"], True
    if c.isdigit() or c in ".-" and len(t) > 1 and t[1].isdigit():
        return (NUM if _number_end[lang.name].match(t) else BAD), True
    if c.isalpha() or c in "_$":
        return (ID if lang.name != "json" else BAD), True
    return BAD, False


WORD = r"[^\W\d][\w$]*"
#: Parts that end with a semicolon, a line end or a group in braces that nothing continues; elements between commas.
_BRACES = "\U00100000-\U0010fffd"
UNITS = rf"(?:[^<;>\n{_BRACES}]|[{_BRACES}](?=[STAY]))*(?:[<;>\n]+|[{_BRACES}][<;>\n]*|\Z)"
NO_LINES = rf"(?:[^<;>{_BRACES}]|[{_BRACES}](?=[STAY]))*(?:[<;>]+|[{_BRACES}][<;>]*|\Z)"
STAY = "else catch finally while , ; = . ? : from"
ELEMENTS = r"[^<,>]+"

C_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|/\*"
DQ, SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[A-Za-z]*\d*"


def ops(text: str) -> str:
    return "|".join(re.escape(t) for t in sorted(text.split(), key=len, reverse=True))


# ---------------------------------------------------------------- JavaScript and TypeScript

JS_OPS = "` JSX ; , . ?. ... ? : => = == === != !== < > <= >= + - * / % ** ++ -- & | ^ ~ ! && || ?? << += -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??= # @"
JS_KEYS = "var let const function async await return if else for while do break continue switch case default throw try catch finally new delete typeof void in instanceof this super null true false class extends static get set of import export from as yield debugger with"
TS_KEYS = " type interface enum declare abstract namespace module readonly public private protected implements keyof is infer unique asserts satisfies override any string number boolean unknown never object symbol bigint undefined accessor global require"
JS_SOFT = "async of get set static from as let"
JS_RE = r"(?:(?<![\w)\]}\"'`$])(?<![\w)\]}\"'`$] )|(?<=return )|(?<=typeof ))/(?![/*=])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
JS_LEX = rf"[ \t\r\f ﻿]+|\n|\A#![^\n]*|{C_COMMENT}|`(?:[^`\\]|\\[\s\S])*`|{DQ}|{SQ}|{JS_RE}|{NUMBER}n?|(?:[^\W\d]|\$)[\w$]*|{ops(JS_OPS.replace("` JSX ", ""))}|[\s\S]"

JS_STATEMENTS = """
Program = Stmts ;
Stmts = StmtT* StmtE? ;
T = ';' | NL ;
StmtT = Simple T+ | Block T* | T | 'if' p.Expr NL* StmtT ('else' NL* StmtT)? | 'for' 'await'? p.ForHead NL* StmtT
  | 'while' p.Expr NL* StmtT | 'do' NL* StmtT 'while' p.Expr T* | ID ':' NL* StmtT | 'with' p.Expr NL* StmtT ;
StmtE = Simple | 'if' p.Expr NL* StmtE | 'if' p.Expr NL* StmtT 'else' NL* StmtE | 'for' 'await'? p.ForHead NL* StmtE
  | 'while' p.Expr NL* StmtE | 'do' NL* StmtT 'while' p.Expr | ID ':' NL* StmtE ;
Block = c.Stmts | 'export'? Decl | 'export' 'default' Decl | 'try' c.Stmts ('catch' p.Param? c.Stmts)? ('finally' c.Stmts)? | 'switch' p.Expr c.Switch ;
Switch = NL* (Case NL*)* ;
Case = ('case' Expr | 'default') ':' NL* Stmts ;
ForHead = (VarDecl | Expr)? ';' Expr? ';' Expr? | ('var' | 'let' | 'const')? Target ('of' | 'in') Expr | LeftOf 'of' Expr ;
LeftOf = Post ;
Simple = VarDecl | Expr | 'return' Expr? | 'throw' Expr | 'break' ID? | 'continue' ID? | 'debugger' | Import
  | 'export' VarDecl | 'export' 'default' A | 'export' c.Names ('from' STR With?)? | 'export' '*' ('as' ANY)? 'from' STR With? ;
With = ('with') c.Obj ;
Import = 'import' STR With? | 'import' Clause 'from' STR With? ;
Clause = ID (',' (c.Names | '*' 'as' ID))? | c.Names | '*' 'as' ID ;
Names = ((NameAs ',')* NameAs ','?)? ;
Expr = A (',' A)* ;
Prim = Prim0 | Class ;
Prim0 = ID | NUM | STR | Template | 'JSX' p.Jsx | 'this' | 'super' | 'null' | 'true' | 'false' | p.Expr | b.Elems | c.Obj | Func | 'import' p.Args | 'import' '.' ID | 'new' '.' ID | '#' ANY ;
Template = '`' (c.Expr '`')* ;
Jsx = c.JsxItem* ;
JsxItem = ('...'? Expr)? ;
Heritage = ('new'* Prim0 | 'class' ID? c.ClassBody) Suffix* ;
Elems = ','* ((Elem ','+)* Elem ','*)? ;
Elem = '...'? A ;
Args = ((Elem ',')* Elem ','?)? ;
Obj = ((Prop ',')* Prop ','?)? ;
Key = ANY | STR | NUM | b.Expr | '#' ANY ;
"""
JS_GRAMMAR = (
    JS_STATEMENTS
    + """
NameAs = (ANY | STR) ('as' (ANY | STR))? ;
VarDecl = ('var' | 'let' | 'const') Bind (',' Bind)* ;
Bind = Target ('=' A)? ;
Target = ID | c.Obj | b.Elems ;
A = U | U BIN A | U '=' A | U '?' A ':' A | Arrow | 'yield' '*'? A? ;
BIN = BINOP | '>' '>'? '>'? '='? | 'in' | 'instanceof' ;
Arrow = 'async'? (ID | p.Params) '=>' (c.Stmts | A) ;
U = PRE* Post ;
Post = Prim Suffix* ('++' | '--')? ;
Suffix = '.' '#'? ANY | '?.' (ANY | p.Args | b.Expr) | b.Expr | p.Args | Template ;
Params = ((Param ',')* Param ','?)? ;
Param = '...'? Target ('=' A)? ;
Func = 'async'? 'function' '*'? ID? p.Params c.Stmts ;
Class = 'class' ID? ('extends' Heritage)? c.ClassBody ;
Decl = Func | Class ;
ClassBody = Member* Field? ;
Member = T | Field T+ | ('static' | 'async' | 'get' | 'set' | '*')* Key p.Params c.Stmts | 'static' c.Stmts ;
Field = 'static'? Key ('=' A)? ;
Prop = Key ':' A | ('async' | 'get' | 'set' | '*')* Key p.Params c.Stmts | ID ('=' A)? | '...' A ;
"""
)
TS_GRAMMAR = (
    JS_STATEMENTS
    + """
NameAs = 'type'? (ANY | STR) ('as' (ANY | STR))? ;
Import = 'import' 'type' Clause 'from' STR | 'import' ID '=' Expr ;
Simple = 'export'? 'declare'? 'type' ID TParams? '=' Type | 'export' 'type' c.Names ('from' STR)? | 'export' '=' Expr
  | 'export'? 'declare' VarDecl | 'export'? 'declare'? 'async'? 'function' '*'? ID TParams? p.Params (':' Type)? | 'export' 'as' 'namespace' ID ;
VarDecl = ('var' | 'let' | 'const') Bind (',' Bind)* ;
Bind = Target '!'? (':' Type)? ('=' A)? ;
Target = ID | c.Obj | b.Elems ;
A = U | U BIN A | U '=' A | U '?' A ':' A | Arrow | 'yield' '*'? A? | U ('as' | 'satisfies') Type Rest? ;
Rest = BIN A | '?' A ':' A | ('as' | 'satisfies') Type Rest? ;
BIN = BINOP | '>' '>'? '>'? '='? | 'in' | 'instanceof' ;
Arrow = 'async'? (ID | TParams? p.Params (':' Type)?) '=>' (c.Stmts | A) ;
U = (PRE | '<' Type '>')* Post ;
Post = Prim Suffix* ('++' | '--')? ;
Suffix = '.' '#'? ANY | '?.' (ANY | p.Args | b.Expr) | b.Expr | TArgs? (p.Args | Template) | '!' ;
Params = ((Param ',')* Param ','?)? ;
Param = Deco* Mod* '...'? (Target | 'this') '?'? (':' Type)? ('=' A)? ;
Mod = 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'static' | 'abstract' | 'declare' | 'async' | 'get' | 'set' | 'accessor' ;
Deco = '@' (ID | p.Expr) Suffix* NL* ;
Func = 'async'? 'function' '*'? ID? TParams? p.Params (':' Type)? c.Stmts ;
Class = Deco* 'abstract'? 'class' ID? TParams? ('extends' Heritage TArgs?)? ('implements' Types1)? c.ClassBody ;
Types1 = Type (',' Type)* ;
Decl = Func | 'declare'? Class | 'declare'? 'interface' ID TParams? ('extends' Types1)? c.TypeLit | 'declare'? 'const'? 'enum' ID c.Enum
  | 'declare'? ('namespace' | 'module') (ID ('.' ID)* | STR) c.Stmts | 'declare' 'global' c.Stmts ;
Enum = ((EnumItem ',')* EnumItem ','?)? ;
EnumItem = (ANY | STR) ('=' A)? ;
ClassBody = Member* (Field | Deco* (Mod | '*')* Key '?'? TParams? p.Params (':' Type)?)? ;
Member = T | Field T+ | Deco* (Mod | '*')* Key '?'? TParams? p.Params (':' Type)? (c.Stmts | T+) | 'static' c.Stmts ;
Field = Deco* Mod* Key ('?' | '!')? (':' Type)? ('=' A)? | Mod* b.Index ':' Type ;
Index = ID ':' Type ;
Prop = Key ':' A | ('async' | 'get' | 'set' | '*')* Key TParams? p.Params (':' Type)? c.Stmts | ID ('=' A)? | '...' A ;
TParams = '<' TParam (',' TParam)* ','? '>' ;
TParam = 'const'? ('in' | ID)? ID ('extends' Type)? ('=' Type)? ;
TArgs = '<' Type (',' Type)* '>' ;
Type = ('|' | '&')? TP (('|' | '&') TP)* ('extends' Type '?' Type ':' Type)? | 'abstract'? 'new'? TParams? p.Params '=>' Type | 'asserts'? (ID | 'this') 'is' Type ;
TP = ('keyof' | 'typeof' | 'readonly' | 'unique' | 'infer') TP | TB TSuffix* ;
TSuffix = b.TIndex | '!' ;
TIndex = Type? ;
TB = ID ('.' ANY)* TArgs? | 'void' | 'null' | 'this' | STR | '-'? NUM | 'true' | 'false' | c.TypeLit | b.Types | p.Type | Template1 | 'import' p.Args ('.' ANY)* TArgs? ;
Template1 = '`' (c.Type '`')* ;
Types = ((TElem ',')* TElem ','?)? ;
TElem = '...'? (ID '?'? ':')? Type '?'? ;
TypeLit = NL* ((TMember (';' | ',' | NL)+)* TMember?)? ;
TMember = ('readonly' | '-' | '+')* Key ('-'? '?')? (':' Type)? | ('readonly' | '-' | '+')* b.Mapped ('-'? '?' | '+' '?')? ':' Type | ('get' | 'set')? Key '?'? TParams? p.Params (':' Type)? | 'new'? TParams? p.Params (':' Type)? ;
Mapped = ID ':' Type | ID 'in' Type ('as' Type)? ;
"""
)
JS_BIN = "== === != !== < <= >= + - * / % ** & | ^ && || ?? << += -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??="
JS_SETS = {"BINOP": JS_BIN, "PRE": "! ~ + - ++ -- typeof void delete await new"}
JS_LISTS = {"Stmts": (UNITS, "Stmts"), "Program": (UNITS, "Stmts"), "ClassBody": (UNITS, "ClassBody"), "Elems": (ELEMENTS, "Elem"), "Args": (ELEMENTS, "Elem"), "Obj": (ELEMENTS, "Prop"), "Names": (ELEMENTS, "NameAs")}

# ---------------------------------------------------------------- Java

JAVA_OPS = "; , . ... ? : :: -> = == != < > <= + - * / % ++ -- & | ^ ~ ! && || << += -= *= /= %= &= |= ^= <<= @"
JAVA_KEYS = "package import static public private protected abstract final native synchronized transient volatile strictfp default class interface enum record extends implements throws void boolean byte short int long char float double return if else for while do break continue switch case throw try catch finally new this super null true false instanceof assert var yield sealed permits when"
JAVA_LEX = rf'[\s﻿]+|{C_COMMENT}|"""[\s\S]*?"""|{DQ}|{SQ}|{NUMBER}|(?:[^\W\d]|\$)[\w$]*|{ops(JAVA_OPS)}|[\s\S]'
JAVA_GRAMMAR = """
Unit = (Import | ';' | TypeDecl)* ;
Package = Anno* 'package' QName ';' ;
Import = 'import' 'static'? QName ('.' '*')? ';' ;
QName = ID ('.' ID)* ;
Anno = '@' QName p.AnnoArgs? ;
AnnoArgs = ((AnnoArg ',')* AnnoArg ','?)? ;
AnnoArg = (ID '=')? AnnoValue ;
AnnoValue = Expr | Anno | c.AnnoArgs ;
Mod = Anno | MODS ;
TypeDecl = Mod* 'class' ID TParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? c.Body
  | Mod* 'interface' ID TParams? ('extends' Types)? ('permits' Types)? c.Body | Mod* '@' 'interface' ID c.Body
  | Mod* 'enum' ID ('implements' Types)? c.EnumBody | Mod* 'record' ID TParams? p.Params ('implements' Types)? c.Body ;
EnumBody = ((EnumItem ',')* EnumItem ','?)? (';' Body)? ;
EnumItem = Anno* ID p.Args? c.Body? ;
Body = Member* ;
Member = ';' | TypeDecl | 'static'? c.Stmts | Mod* TParams? (Type | 'void') ID p.Params b.Empty* ('throws' Types)? (c.Stmts | ';' | 'default' AnnoValue ';')
  | Mod* TParams? ID p.Params? ('throws' Types)? c.Stmts | Mod* Type Vars ';' ;
Empty = ;
Vars = Var (',' Var)* ;
Var = ID b.Empty* ('=' Init)? ;
Init = Expr | c.Inits ;
Inits = ((Init ',')* Init ','?)? ;
TParams = '<' TParam (',' TParam)* '>' ;
TParam = Anno* ID ('extends' Type ('&' Type)*)? ;
TArgs = '<' ((TArg ',')* TArg)? '>' ;
TArg = Anno* (Type | '?' (('extends' | 'super') Type)?) ;
Type = Anno* (PRIM | ID TArgs? ('.' Anno* ID TArgs?)*) (Anno* b.Empty)* ;
Types = Type (',' Type)* ;
Params = ((Param ',')* Param)? ;
Param = Mod* Type '...'? (ID | 'this') b.Empty* ;
Stmts = Stmt* ;
Stmt = ';' | c.Stmts | Mod* (Type | 'var') Vars ';' | TypeDecl | Expr ';' | 'if' p.Expr Stmt ('else' Stmt)? | 'for' p.ForHead Stmt
  | 'while' p.Expr Stmt | 'do' Stmt 'while' p.Expr ';' | 'return' Expr? ';' | 'throw' Expr ';' | 'break' ID? ';' | 'continue' ID? ';' | 'yield' Expr ';'
  | 'try' p.Resources? c.Stmts ('catch' p.Catch c.Stmts)* ('finally' c.Stmts)? | 'switch' p.Expr c.Switch | 'synchronized' p.Expr c.Stmts
  | 'assert' Expr (':' Expr)? ';' | ID ':' Stmt ;
Resources = (Resource ';')* Resource ';'? ;
Resource = Mod* (Type | 'var') ID '=' Expr | Expr ;
Catch = Mod* Type ('|' Type)* ID ;
ForHead = (Mod* (Type | 'var') Vars | ExprList)? ';' Expr? ';' ExprList? | Mod* (Type | 'var') ID ':' Expr ;
ExprList = Expr (',' Expr)* ;
Switch = (Label ':' Stmts | Label '->' (Expr ';' | c.Stmts | 'throw' Expr ';'))* ;
Label = 'case' Pattern (',' Pattern)* ('when' Expr)? | 'default' ;
Pattern = Expr | Mod* Type (ID | p.Patterns)? | 'default' ;
Patterns = ((Pattern ',')* Pattern)? ;
Args = ((Expr ',')* Expr)? ;
Expr = U | U BIN Expr | U '?' Expr ':' Expr | U 'instanceof' 'final'? Type (ID | p.Patterns)? Rest? | Lambda ;
Rest = BIN Expr | '?' Expr ':' Expr ;
BIN = BINOP | '>' '>'? '>'? '='? ;
Lambda = (ID | p.LParams) '->' (Expr | c.Stmts) ;
LParams = ((ID ',')* ID)? | Params | (('var' ID ',')* 'var' ID)? ;
U = (PRE | p.Cast)* (Post | p.Cast Lambda) ;
Cast = Type ('&' Type)* ;
Post = Prim Suffix* ('++' | '--')? ;
Prim = ID | NUM | STR | 'this' | 'super' | 'null' | 'true' | 'false' | p.Expr | 'new' Anno* New | Type '.' 'class' | 'void' '.' 'class' | Type '::' (ID | 'new') | 'switch' p.Expr c.Switch ;
New = NType p.Args c.Body? | NType b.Expr+ b.Empty* | NType b.Empty+ c.Inits | PRIM b.Expr+ b.Empty* | PRIM b.Empty+ c.Inits ;
NType = ID TArgs? ('.' ID TArgs?)* ;
Suffix = '.' TArgs? ID | '.' 'this' | '.' 'class' | '.' 'new' ID p.Args | '.' 'super' | b.Expr | p.Args | '::' (ID | 'new') ;
"""
JAVA = {
    "MODS": "public private protected abstract final native synchronized transient volatile strictfp default static sealed",
    "PRIM": "boolean byte short int long char float double",
    "BINOP": "= == != < <= + - * / % & | ^ && || << += -= *= /= %= &= |= ^= <<=",
    "PRE": "! ~ + - ++ --",
}

# ---------------------------------------------------------------- Go

GO_OPS = "; , . ... : := = == != < > <= >= + - * / % ++ -- & | ^ ! && || << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= <- ~"
GO_KEYS = "package import func var const type struct interface map chan return if else for range break continue goto fallthrough switch case default select go defer"
GO_LEX = rf"[ \t\r﻿]+|\n|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|/\*|`[^`]*`|{DQ}|'(?:[^'\\\n]|\\[\s\S])+'|{NUMBER}|{WORD}|{ops(GO_OPS)}|[\s\S]"
GO_GRAMMAR = """
File = ((Import | Decl) ';')* (Import | Decl)? ;
Import = 'import' ImportSpec | 'import' p.Imports ;
Imports = (ImportSpec ';')* ImportSpec? ;
ImportSpec = (ID | '.')? STR ;
Decl = Func | 'var' VarSpec | 'var' p.VarSpecs | 'const' ConstSpec | 'const' p.ConstSpecs | 'type' TypeSpec | 'type' p.TypeSpecs ;
VarSpecs = (VarSpec ';')* VarSpec? ;
VarSpec = Ids (Type ('=' Exprs)? | '=' Exprs) ;
ConstSpecs = (ConstSpec ';')* ConstSpec? ;
ConstSpec = Ids (Type? '=' Exprs)? ;
TypeSpecs = (TypeSpec ';')* TypeSpec? ;
TypeSpec = ID b.TParams? '='? Type ;
TParams = (TParam ',')* TParam ','? ;
TParam = Ids Constraint ;
Constraint = '~'? Type ('|' '~'? Type)* ;
Ids = ID (',' ID)* ;
Func = 'func' p.Params? ID b.TParams? p.Params Result? c.Stmts? ;
Result = Type | p.Params ;
Params = ((Param ',')* Param ','?)? ;
Param = ID? '...'? Type | ID ;
Type = ID ('.' ID)? b.Types? | '*' Type | b.Empty Type | b.Len Type | 'map' b.Type Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' p.Params Result? | 'struct' c.Fields | 'interface' c.Methods | p.Type ;
Empty = ;
Len = Expr | '...' ;
Types = (Type ',')* Type ','? ;
Fields = (Field ';')* Field? ;
Field = Ids Type STR? | '*'? ID ('.' ID)? b.Types? STR? ;
Methods = (Method ';')* Method? ;
Method = ID p.Params Result? | Constraint ;
Stmts = (Stmt? ';')* Stmt? ;
Stmt = Decl | Simple | 'return' Exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | 'go' Expr | 'defer' Expr | c.Stmts | If | For | Switch | 'select' c.Cases | ID ':' Stmt? ;
Simple = Expr | Expr ('++' | '--') | Exprs ASSIGN Exprs | Exprs ':=' Exprs | Expr '<-' Expr ;
If = 'if' (Simple? ';')? Expr c.Stmts ('else' (If | c.Stmts))? ;
For = 'for' (Expr | Simple? ';' Expr? ';' Simple? | (Exprs ('=' | ':='))? 'range' Expr)? c.Stmts ;
Switch = 'switch' (Simple? ';')? Guard? c.Cases ;
Guard = Expr | ID ':=' Expr ;
Cases = (Case)* ;
Case = ('case' CaseHead | 'default') ':' Stmts ;
CaseHead = TypeOrExpr (',' TypeOrExpr)* | (Exprs ('=' | ':='))? Expr | Expr '<-' Expr ;
TypeOrExpr = Expr | Type ;
Exprs = Expr (',' Expr)* ;
Expr = U (BIN U)* ;
U = PRE* Prim Suffix* ;
Prim = ID | NUM | STR | p.TypeOrExpr | Lit c.Elems | 'func' p.Params Result? c.Stmts | b.Empty Type p.Args | 'map' b.Type Type | 'chan' Type | b.Empty Type | 'struct' c.Fields | 'interface' c.Methods ;
Lit = ID ('.' ID)? b.Types? | b.Empty Type | b.Len Type | 'map' b.Type Type | 'struct' c.Fields ;
Elems = ((Elem ',')* Elem ','?)? ;
Elem = (Value ':')? Value ;
Value = Expr | c.Elems ;
Suffix = '.' ID | '.' p.Assert | b.Index | p.Args ;
Assert = Type | 'type' ;
Index = Exprs ','? | Types | Expr? ':' Expr? (':' Expr)? ;
Args = ((Arg ',')* Arg '...'? ','?)? ;
Arg = TypeOrExpr ;
"""
GO = {"ASSIGN": "= += -= *= /= %= &= |= ^= <<= >>= &^=", "BIN": "== != < > <= >= + - * / % & | ^ && || << >> &^", "PRE": "! + - * & ^ <- ~"}

# ---------------------------------------------------------------- Rust

RS_OPS = "; , . .. ..= ... : :: -> => = == != < > <= + - * / % & | ^ ! && || << += -= *= /= %= &= |= ^= <<= @ # ? ' $ ~"
RS_KEYS = "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union macro_rules"
RS_LEX = rf"""[\s﻿]+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|/\*|b?r#+"[\s\S]*?"#+|b?r"[^"]*"|b?"(?:[^"\\]|\\[\s\S])*"|b?'(?:[^'\\\n]|\\(?:[^u]|u\{{[0-9a-fA-F_]+\}})[0-9a-fA-F]*)'|'[^\W\d]\w*|(?:0[xob][0-9a-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)(?:[iuf]\w*)?|{WORD}|{ops(RS_OPS)}|[\s\S]"""
RS_GRAMMAR = """
File = Inner* Item* ;
Inner = '#' '!' b.Tokens ;
Tokens = TOK* ;
TOK = ANY | NUM | STR | LIFE | OPS | p.Tokens | b.Tokens | c.Tokens ;
Attr = '#' b.Tokens ;
Vis = 'pub' p.Path? ;
Item = Attr* Vis? Item1 ;
Item1 = 'use' Use ';' | 'mod' ID (';' | c.File) | 'extern' 'crate' (ID | 'self') ('as' ID)? ';' | Fn (c.Stmts | ';') | 'struct' ID GParams? (Where? c.Fields | p.TFields? Where? ';') | 'union' ID GParams? Where? c.Fields
  | 'enum' ID GParams? Where? c.Variants | 'const' 'mut'? (ID | '_') (':' Type)? ('=' Expr)? ';' | 'static' 'mut'? ID ':' Type ('=' Expr)? ';' | 'type' ID GParams? (':' Bounds)? Where? ('=' Type)? Where? ';'
  | 'unsafe'? 'impl' GParams? '!'? Type ('for' Type)? Where? c.Items | 'unsafe'? 'trait' ID GParams? (':' Bounds)? Where? c.Items | 'unsafe'? 'extern' STR? c.Items
  | Path '!' ID? (p.Tokens ';' | b.Tokens ';' | c.Tokens) | 'macro_rules' '!' ID (c.Tokens | p.Tokens ';') ;
Items = Inner* Item* ;
Use = (Path '::')? ('*' | c.Uses) | '::'? Path ('as' (ID | '_'))? | '::' c.Uses ;
Uses = ((Use ',')* Use ','?)? ;
Fn = 'default'? 'const'? 'async'? 'unsafe'? ('extern' STR?)? 'fn' ID GParams? p.Params ('->' Type)? Where? ;
Params = ((Param ',')* Param ','?)? ;
Param = Attr* (Pattern ':' Type | '&'? LIFE? 'mut'? 'self' (':' Type)? | Type | '...') ;
Fields = ((Field ',')* Field ','?)? ;
Field = Attr* Vis? ID ':' Type ;
TFields = ((TField ',')* TField ','?)? ;
TField = Attr* Vis? Type ;
Variants = ((Variant ',')* Variant ','?)? ;
Variant = Attr* Vis? ID (c.Fields | p.TFields)? ('=' Expr)? ;
GParams = '<' ((GParam ',')* GParam ','?)? '>' ;
GParam = Attr* (LIFE (':' Bounds)? | ID (':' Bounds)? ('=' Type)? | 'const' ID ':' Type ('=' Expr)?) ;
Where = 'where' ((WhereItem ',')* WhereItem ','?)? ;
WhereItem = ('for' GParams)? (Type | LIFE) ':' Bounds ;
Bounds = (Bound ('+' Bound)* '+'?)? ;
Bound = LIFE | '?'? ('for' GParams)? Path | p.Bound ;
GArgs = '<' ((GArg ',')* GArg ','?)? '>' ;
GArg = LIFE | Type | ID GArgs? '=' Type | ID ':' Bounds | '-'? NUM | STR | c.Stmts | 'true' | 'false' ;
Path = '::'? Seg ('::' Seg)* | Qual ('::' Seg)+ ;
Seg = (ID | 'self' | 'Self' | 'super' | 'crate') (GArgs | p.Types ('->' Type)?)? ;
Qual = '<' Type ('as' Path)? '>' ;
Types = ((Type ',')* Type ','?)? ;
Type = Path | '&' LIFE? 'mut'? Type | '&&' LIFE? 'mut'? Type | '*' ('const' | 'mut') Type | p.Types | b.Array | '!' | '_' | ('dyn' | 'impl') Bounds | ('for' GParams)? 'unsafe'? ('extern' STR?)? 'fn' p.Params ('->' Type)? | Path '!' (p.Tokens | b.Tokens | c.Tokens) ;
Array = Type (';' Expr)? ;
Pattern = '|'? Pat ('|' Pat)* ;
Pat = ('ref' | 'mut')* ID ('@' Pat)? | '_' | '..' | Lit (('..=' | '..' | '...') Lit?)? | Path ((('..=' | '..') (Lit | Path)?)? | p.Patterns | c.PFields) | '&' 'mut'? Pat | '&&' 'mut'? Pat | p.Patterns | b.Patterns | 'box' Pat | Path '!' (p.Tokens | b.Tokens | c.Tokens) | ('..=' | '..') Lit ;
Patterns = ((Pattern ',')* Pattern ','?)? ;
PFields = ((PField ',')* PField ','?)? ;
PField = Attr* (ID ':' Pattern | NUM ':' Pattern | ('ref' | 'mut')* ID | '..') ;
Lit = '-'? NUM | STR | 'true' | 'false' ;
Stmts = Inner* Stmt* Expr? ;
Stmt = ';' | Item | Attr* 'let' Pattern (':' Type)? ('=' Expr ('else' c.Stmts)?)? ';' | Attr* Expr ';' | Attr* BlockExpr ;
BlockExpr = (LIFE ':')? ('unsafe' | 'async' 'move'? | 'const')? c.Stmts | If | Match | (LIFE ':')? ('loop' c.Stmts | 'while' Cond c.Stmts | 'for' Pattern 'in' Expr c.Stmts) ;
If = 'if' Cond c.Stmts ('else' (If | c.Stmts))? ;
Cond = Expr | 'let' Pattern '=' Expr | Cond '&&' Cond ;
Match = 'match' Expr c.Arms ;
Arms = Inner* (Arm)* LastArm? ;
Arm = Attr* Pattern ('if' Cond)? '=>' (Expr ',' | BlockExpr ','?) ;
LastArm = Attr* Pattern ('if' Cond)? '=>' Expr ;
Expr = U | U BIN Expr | U RANGE Expr? | RANGE Expr? | U 'as' Type Rest? | Jump ;
Rest = BIN Expr | RANGE Expr? | 'as' Type Rest? ;
RANGE = '..' | '..=' ;
BIN = BINOP | '>' '>'? '='? ;
Jump = 'return' Expr? | 'break' LIFE? Expr? | 'continue' LIFE? | 'async'? 'move'? ('|' Closure? '|' | '||') ('->' Type)? Expr ;
Closure = (CParam ',')* CParam ','? ;
CParam = Attr* Pat (':' Type)? ;
U = PRE* Prim Suffix* ;
Prim = Path | Lit | p.Exprs | b.Exprs | b.Repeat | BlockExpr | Path c.Inits | Path '!' (p.Tokens | b.Tokens | c.Tokens) | EPath ;
EPath = '::'? ESeg ('::' ESeg)* ('!' (p.Tokens | b.Tokens | c.Tokens) | c.Inits)? ;
ESeg = (ID | 'self' | 'Self' | 'super' | 'crate') ('::' GArgs)? ;
Repeat = Expr ';' Expr ;
Exprs = ((Expr ',')* Expr ','?)? ;
Inits = ((InitItem ',')* InitItem ','?)? ('..' Expr)? ;
InitItem = Attr* (ID | NUM) (':' Expr)? | '..' Expr ;
Suffix = '.' (ID ('::' GArgs)? | NUM | 'await') | '?' | p.Exprs | b.Exprs ;
"""
RS = {
    "BINOP": "= == != < <= + - * / % & | ^ && || << += -= *= /= %= &= |= ^= <<=",
    "PRE": "! - * & && mut",
    "LIFE": "'",
    "OPS": "; , . .. ..= ... : :: -> => = == != < > <= + - * / % & | ^ ! && || << += -= *= /= %= &= |= ^= <<= @ # ? $ ~",
}

# ---------------------------------------------------------------- C

C_OPS = "; , . -> ... ? : = == != < > <= >= + - * / % ++ -- & | ^ ~ ! && || << >> += -= *= /= %= &= |= ^= <<= >>= ::"
C_KEYS = "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Static_assert __attribute__ _Alignas _Alignof _Noreturn _Thread_local __inline __restrict __extension__ asm __asm__"
C_LEX = rf"(?m:^[ \t]*#(?:[^\n\\/\"']|\\[\s\S]|/(?![*/])|{DQ}|'[^'\n]*'|/\*(?:[^*]|\*(?!/))*\*/|\"|')*)|[\s﻿]+|{C_COMMENT}|\\\n|(?:u8|[uUL])?{DQ}|[uUL]?'(?:[^'\\\n]|\\[\s\S])+'|{NUMBER}|(?:[^\W\d]|\$)[\w$]*|{ops(C_OPS)}|[\s\S]"
C_GRAMMAR = """
File = Ext* ;
Ext = ';' | Attr* Specs Attr* (Decl1 (',' Decl1)*)? ';' | Specs Attr* Declor KR* c.Stmts | Declor c.Stmts | '_Static_assert' p.Args ';' | 'extern' STR c.File | ID p.Args ';' | ('asm' | '__asm__') p.Asm ';' ;
KR = Specs Declor (',' Declor)* ';' ;
Attr = '__attribute__' p.Tokens | '_Alignas' p.Tokens ;
Tokens = TOK* ;
TOK = ANY | NUM | STR | OPS | p.Tokens | b.Tokens | c.Tokens ;
Specs = Qual* TypeName Qual2* ;
Qual = QUAL | Attr ;
Qual2 = QUAL | BASIC | Attr ;
TypeName = BASIC | ID | ('struct' | 'union') Attr* ID? c.Fields | ('struct' | 'union') Attr* ID | 'enum' Attr* ID? c.Enums | 'enum' Attr* ID ;
Fields = Field* ;
Field = Attr* Specs (Declor? (':' Expr)? Attr* (',' Declor? (':' Expr)? Attr*)*)? ';' | ';' ;
Enums = ((EnumItem ',')* EnumItem ','?)? ;
EnumItem = ID ('=' A)? ;
Decl1 = Declor (('asm' | '__asm__') p.Asm)? Attr* ('=' Init)? ;
Declor = Ptr* (ID | p.Declor) Tail* ;
Ptr = '*' QUAL* | Attr ;
Tail = p.Params | b.Dim | Attr ;
Dim = ('static' | QUAL)* Expr? | '*' ;
Params = ((Param ',')* Param (',' '...')?)? | Ids ;
Ids = (ID ',')* ID ;
Param = Attr* Specs (Declor | Abs)? Attr* ;
Abs = Ptr* Tail+ | Ptr+ | Ptr* p.Abs Tail* ;
Init = A | c.Inits ;
Inits = ((InitItem ',')* InitItem ','?)? ;
InitItem = (Desig+ '=')? Init | ID ':' Init ;
Desig = '.' ID | b.Expr ;
Stmts = Stmt* ;
Stmt = ';' | c.Stmts | Attr* Specs Attr* Decl1 (',' Decl1)* ';' | Attr* Specs ';' | Expr ';' | 'if' p.Expr Stmt ('else' Stmt)? | 'for' p.ForHead Stmt | 'while' p.Expr Stmt | 'do' Stmt 'while' p.Expr ';'
  | 'return' (Expr | c.Inits)? ';' | 'break' ';' | 'continue' ';' | 'goto' ID ';' | 'switch' p.Expr Stmt | 'case' Expr ('...' Expr)? ':' Stmt? | 'default' ':' Stmt? | ID ':' Attr* Stmt? | '_Static_assert' p.Args ';' | ('asm' | '__asm__') QUAL* p.Asm ';' ;
Asm = Tokens ;
ForHead = (Specs Decl1 (',' Decl1)* | Expr)? ';' Expr? ';' Expr? ;
Expr = A (',' A)* ;
A = U | U BIN A | U '?' Expr? ':' A ;
U = (PRE | p.TypeRef)* (Post | ('sizeof' | '_Alignof') p.TypeRef | p.TypeRef c.Inits Suffix*) ;
TypeRef = Specs Abs? ;
Post = Prim Suffix* ;
Prim = ID | NUM | STR+ | p.Expr | p.Block1 ;
Block1 = c.Stmts ;
Suffix = '.' ID | '->' ID | b.Expr | p.Args | '++' | '--' ;
Args = ((Arg ',')* Arg)? ;
Arg = A | TypeRef ;
"""
C = {
    "QUAL": "const volatile static extern inline register restrict typedef auto _Noreturn _Thread_local __inline __restrict __extension__",
    "BASIC": "char double float int long short signed unsigned void _Bool",
    "BIN": "= == != < > <= >= + - * / % & | ^ && || << >> += -= *= /= %= &= |= ^= <<= >>=",
    "PRE": "! ~ + - ++ -- * & && sizeof __extension__",
    "OPS": C_OPS,
}

# ---------------------------------------------------------------- JSON

JSON_LEX = r'[ \t\r\n﻿]+|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[A-Za-z_]\w*|[,:{}\[\]]|[\s\S]'
JSON_GRAMMAR = """
Doc = Value ;
Value = NUM | STR | 'true' | 'false' | 'null' | b.Values | c.Pairs ;
Values = (Value (',' Value)*)? ;
Pairs = (Pair (',' Pair)*)? ;
Pair = STR ':' Value ;
"""

# ---------------------------------------------------------------- Python

PY_OPS = "; , . ... : := = == != < > <= >= + - * / // % ** @ & | ^ ~ << >> -> += -= *= /= //= %= **= @= &= |= ^= <<= >>= !"
PY_KEYS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type _"
PY_STR = r"(?i:rb|br|[rbuf]|fr|rf)?(?:'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|''(?!')|\"\"(?!\"))"
PY_NUM = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:0(?:_?0)*|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*|\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?|(?=[eEjJ])))(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)"
PY_LEX = rf"\n[ \t\f]*|[ \t\r\f﻿]+|#[^\n]*|\\\r?\n|{PY_STR}|{PY_NUM}|{WORD}|{ops(PY_OPS)}|[\s\S]"
PY_GRAMMAR = """
Line = Simple (';' Simple)* ';'? ;
Simple = Exprs | Target ':' Expr ('=' Value)? | (Exprs '=')+ Value | Expr AUG Value | 'return' Exprs? | 'pass' | 'break' | 'continue' | 'raise' (Expr ('from' Expr)?)?
  | 'import' DottedAs (',' DottedAs)* | 'from' ('.' | '...')* Dotted? 'import' ('*' | NameAs (',' NameAs)* | p.NamesAs) | 'global' Ids | 'nonlocal' Ids | 'del' Exprs | 'assert' Expr (',' Expr)? | 'type' ID b.Types? '=' Expr ;
Target = Post ;
Value = Exprs | 'yield' Yield ;
Yield = 'from' Expr | Exprs? ;
Types = ((TypeP ',')* TypeP ','?)? ;
TypeP = ('*' | '**')? ID (':' Expr)? ('=' Expr)? ;
Ids = ID (',' ID)* ;
Dotted = ID ('.' ID)* ;
DottedAs = Dotted ('as' ID)? ;
NameAs = ID ('as' ID)? ;
NamesAs = (NameAs ',')* NameAs ','? ;
If = 'if' Named ':' Line? ;
Elif = 'elif' Named ':' Line? ;
Else = 'else' ':' Line? ;
While = 'while' Named ':' Line? ;
For = 'async'? 'for' Targets 'in' Exprs ':' Line? ;
Targets = (TargetStar ',')* TargetStar ','? ;
TargetStar = '*'? Post ;
Try = 'try' ':' Line? ;
Except = 'except' '*'? (Exprs ('as' ID)?)? ':' Line? ;
Finally = 'finally' ':' Line? ;
With = 'async'? 'with' (WithItem (',' WithItem)* | p.WithItems) ':' Line? ;
WithItems = (WithItem ',')* WithItem ','? ;
WithItem = Expr ('as' TargetStar)? ;
Def = 'async'? 'def' ID b.Types? p.Params ('->' Expr)? ':' Line? ;
Class = 'class' ID b.Types? p.Args? ':' Line? ;
Deco = '@' Named ;
Match = 'match' Exprs ':' ;
Case = 'case' Patterns ('if' Named)? ':' Line? ;
Patterns = (Pattern ',')* Pattern ','? ;
Pattern = '*'? Pat1 ('|' Pat1)* ('as' ID)? ;
Pat1 = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | Dotted p.PArgs? | p.PGroup | b.PGroup | c.PMap ;
PGroup = Patterns? ;
PArgs = (((ID '=')? Pattern ',')* (ID '=')? Pattern ','?)? ;
PMap = ((PPair ',')* PPair ','?)? ;
PPair = Pat1 ':' Pattern | '**' ID ;
Params = ((Param ',')* Param ','?)? ;
Param = ID (':' StarExpr)? ('=' Expr)? | '*' | '/' | '*' ID (':' StarExpr)? | '**' ID (':' Expr)? ;
LParams = ((LParam ',')* LParam ','?)? ;
LParam = ID ('=' Expr)? | '*' | '/' | '*' ID | '**' ID ;
StarExpr = '*'? Expr ;
Exprs = (StarExpr ',')* StarExpr ','? ;
Named = Expr | ID ':=' Expr ;
Expr = Or ('if' Or 'else' Expr)? | 'lambda' LParams ':' Expr ;
Or = Not (BOOL Not)* ;
Not = 'not'* Cmp ;
Cmp = U (BIN U)* ;
BIN = BINOP | 'not' 'in' | 'is' 'not'? | 'in' ;
U = PRE* Post ;
Post = Prim Suffix* ;
Prim = ID | NUM | STR+ | 'None' | 'True' | 'False' | '...' | p.Paren | b.List | c.Set ;
Suffix = '.' ID | p.Args | b.Index ;
Paren = ((NStar ',')* NStar ','?)? | Named CompFor | 'yield' Yield ;
NStar = '*' Expr | Named ;
List = ((NStar ',')* NStar ','?)? | Named CompFor ;
Set = ((NStar ',')* NStar ','?)? | Named CompFor | ((Pair ',')* Pair ','?)? | Expr ':' Expr CompFor ;
Pair = Expr ':' Expr | '**' Expr ;
CompFor = ('async'? 'for' Targets 'in' Or ('if' Named1)*)+ ;
Named1 = Or | ID ':=' Or | 'lambda' LParams ':' Expr ;
Index = (Slice ',')* Slice ','? ;
Slice = NStar | Expr? ':' Expr? (':' Expr?)? ;
Args = ((Arg ',')* Arg ','?)? | Named CompFor ;
Arg = Named | ID '=' Expr | '*' Expr | '**' Expr ;
"""
PY = {
    "AUG": "+= -= *= /= //= %= **= @= &= |= ^= <<= >>=",
    "BOOL": "and or",
    "BINOP": "== != < > <= >= + - * / // % ** @ & | ^ << >>",
    "PRE": "+ - ~ await",
}
#: Kinds of lines by the letter that stands for them in PY_BLOCK.
PY_LINES = {"s": "Line", "I": "If", "E": "Elif", "L": "Else", "W": "While", "F": "For", "T": "Try", "X": "Except", "Y": "Finally", "H": "With", "D": "Def", "C": "Class", "@": "Deco", "M": "Match", "K": "Case"}
PY_BLOCK = """
Block = Stmt+ | Case+ ;
Stmt = 's' | 'I' 'E'* 'L'? | 'W' 'L'? | 'F' 'L'? | 'T' ('X'+ 'L'? 'Y'? | 'Y') | 'H' | '@'* ('D' | 'C') | 'M' ;
Case = 'K' ;
"""


def languages() -> dict[str, Language]:
    js = dict(sets=JS_SETS, lists=JS_LISTS, newlines="asi", start="Program")
    angle = {"BINOP": JS_BIN, "PRE": JS_SETS["PRE"]}
    return {
        "javascript": Language("javascript", JS_KEYS, JS_OPS, JS_LEX, JS_GRAMMAR, soft=JS_SOFT, **js),
        "typescript": Language("typescript", JS_KEYS + TS_KEYS, JS_OPS, JS_LEX, TS_GRAMMAR, soft=JS_SOFT + TS_KEYS, **js | {"sets": angle}),
        "java": Language("java", JAVA_KEYS, JAVA_OPS, JAVA_LEX, JAVA_GRAMMAR, "Unit", JAVA, {"Unit": (NO_LINES, "Unit"), "Stmts": (NO_LINES, "Stmts"), "Body": (NO_LINES, "Body"), "Inits": (ELEMENTS, "Init"), "Args": (ELEMENTS, "Expr")}, soft="record var yield sealed permits when"),
        "go": Language("go", GO_KEYS, GO_OPS, GO_LEX, GO_GRAMMAR, "File", GO, {"File": (NO_LINES, "File"), "Stmts": (NO_LINES, "Stmts"), "Elems": (ELEMENTS, "Elem")}, newlines="go"),
        "rust": Language("rust", RS_KEYS + " _ default box", RS_OPS, RS_LEX, RS_GRAMMAR, "File", RS, {"File": (NO_LINES, "File"), "Items": (NO_LINES, "Items"), "Exprs": (ELEMENTS, "Expr"), "Stmts": (NO_LINES, "Stmts")}, soft="union default box macro_rules"),
        "c": Language("c", C_KEYS, C_OPS, C_LEX, C_GRAMMAR, "File", C, {"File": (NO_LINES, "File"), "Stmts": (NO_LINES, "Stmts"), "Inits": (ELEMENTS, "InitItem"), "Args": (ELEMENTS, "Arg")}),
        "json": Language("json", "true false null", ", :", JSON_LEX, JSON_GRAMMAR, "Doc", lists={"Values": (ELEMENTS, "Value"), "Pairs": (ELEMENTS, "Pair")}),
        "python": Language("python", PY_KEYS, PY_OPS, PY_LEX, PY_GRAMMAR, "Line", PY, {"List": (ELEMENTS, "NStar"), "Set": (ELEMENTS, "Pair"), "Paren": (ELEMENTS, "NStar")}, newlines="py", soft="match case type _"),
    }

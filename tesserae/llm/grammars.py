"""Lexers and grammars of the languages that :mod:`tesserae.llm.syntax` recognises.

A lexer turns a text into a string over the grammar's alphabet with raw bracket characters, or None if
a token cannot be formed. ``<`` and ``>`` are the brackets of an indented Python block.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from typing import NamedTuple

from tesserae.llm.gll import END, Grammar

PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}

JSON = """
File : Value
Value : STR | NUM | 'true' | 'false' | 'null' | {:Members:} | [:Elements:]
Members : (Member (',' Member)*)?
Member : STR ':' Value
Elements : (Value (',' Value)*)?
"""

PYTHON = """
File :: Statement
Block :: Statement
Statement : Simple | Compound | @py2 OLD NL
Simple : Small (';' Small)* ';'? NL
Suite : ':' <:Block:> | ':' Simple
Small : Expressions | Assigned | Yield | 'pass' | 'break' | 'continue' | 'del' Deleted (',' Deleted)* ','?
 | 'return' Expressions? | 'raise' (Expr (@py3 'from' Expr)?)? | 'global' ID (',' ID)* | @py3 'nonlocal' ID (',' ID)*
 | 'import' Module (',' Module)* | 'from' Relative 'import' Imported | 'assert' Expr (',' Expr)? | @py3 'type' ID TypeParams? '=' Expr
 | @py2 'print' (Expr (',' Expr)* ','?)? | @py2 'print' '>>' Expr (',' Expr)* ','? | @py2 'exec' Expr ('in' Expr (',' Expr)?)? | @py2 'raise' Expr ',' Expr (',' Expr)?
Assigned : (Targets '=')+ Value | Single AUGMENTED Value | @py3 Single ':' Expr ('=' Value)?
Value : Expressions | Yield
Yield : 'yield' Expressions? | @py3 'yield' 'from' Expr
Targets : StarTarget (',' StarTarget)* ','?
StarTarget : Target | @py3 '*' Target
Target : ID | Member | (:GroupTargets:) | [:ListTargets:]
Member : Atom Trailer* Last
Last : '.' ID | [:Subscripts:]
GroupTargets : (Target | StarTarget ',' (StarTarget (',' StarTarget)* ','?)?)?
ListTargets : Targets?
Single : ID | Member | (:SingleTarget:)
SingleTarget : Single
Deleted : ID | Member | (:DeletedTargets:) | [:DeletedTargets:]
DeletedTargets : (Deleted (',' Deleted)* ','?)?
Module : Dotted ('as' ID)?
Dotted : ID ('.' ID)*
Relative : Dots* Dotted | Dots+
Dots : '.' | '...'
Imported : '*' | Name (',' Name)* | (:Names:)
Names : Name (',' Name)* ','?
Name : ID ('as' ID)?
Compound : If | While | For | Try | With | Function | Class | @py3 Match | @py3 'async' (For | With | Function) | Decorator+ (Function | Class | @py3 'async' Function)
If : 'if' Named Suite ('elif' Named Suite)* ('else' Suite)?
While : 'while' Named Suite ('else' Suite)?
For : 'for' Targets 'in' Expressions Suite ('else' Suite)?
Try : 'try' Suite Except+ ('else' Suite)? ('finally' Suite)? | @py3 'try' Suite ExceptGroup+ ('else' Suite)? ('finally' Suite)? | 'try' Suite 'finally' Suite
Except : 'except' (Expr ('as' ID)?)? Suite | @py2 'except' Expr ',' Target Suite | @py2 'except' Expr 'as' Target Suite
ExceptGroup : 'except' '*' Expr ('as' ID)? Suite
With : 'with' WithItem (',' WithItem)* Suite | @py3 'with' (:WithItems:) Suite
WithItems : WithItem (',' WithItem)* ','?
WithItem : Expr ('as' StarTarget)?
Function : 'def' ID TypeParams? (:Parameters:) (@py3 '->' Expr)? Suite
Parameters : (Positional (',' Starred)? ','? | Starred ','?)?
Positional : Plain (',' Plain)* (',' Slash)? (',' Plain)* (',' Default)* | (Plain ',')* Default (',' Default)* ',' Slash (',' Default)* | Default (',' Default)*
Slash : @py3 '/'
Plain : ID Annotation? | @py2 (:TuplePlain:)
Default : Plain '=' Expr
TuplePlain : TupleItem (',' TupleItem)* ','?
TupleItem : ID | (:TuplePlain:)
Annotation : @py3 ':' Expr
Starred : '*' Rest (@py3 ',' KeywordOnly)* (',' '**' Plain)? | @py3 '*' (',' KeywordOnly)+ (',' '**' Plain)? | '**' Plain
Rest : ID Annotation? | @py3 ID ':' Star
KeywordOnly : Plain | Default
Class : 'class' ID TypeParams? (:Arguments:)? Suite
TypeParams : @py3 [:TypeParamList:]
TypeParamList : TypeParam (',' TypeParam)* ','?
TypeParam : ID (':' Expr)? ('=' Expr)? | '*' ID ('=' (Expr | Star))? | '**' ID ('=' Expr)?
Decorator : '@' Named NL
Match : 'match' Subject ':' <:Cases:>
Subject : Element ',' (Element (',' Element)* ','?)? | Named
Cases :: Case
Case : 'case' (Choices | Open) ('if' Named)? Suite
Open : MaybeStar ',' (MaybeStar (',' MaybeStar)* ','?)?
MaybeStar : Choices | '*' ID
Choices : Choice ('as' ID)?
Choice : Closed ('|' Closed)*
Closed : '-'? Number (('+' | '-') Number)? | Strings | 'None' | 'True' | 'False' | Dotted | Dotted (:PatternArguments:) | (:GroupPattern:) | [:ListPattern:] | {:PatternItems:}
GroupPattern : (Choices | Open)?
ListPattern : (MaybeStar (',' MaybeStar)* ','?)?
PatternArguments : (Choices (',' Choices)* (',' ID '=' Choices)* ','? | ID '=' Choices (',' ID '=' Choices)* ','?)?
PatternItems : (PatternItem (',' PatternItem)* (',' '**' ID)? ','? | '**' ID ','?)?
PatternItem : Key ':' Choices
Key : '-'? Number (('+' | '-') Number)? | Strings | 'None' | 'True' | 'False' | ID ('.' ID)+
Expressions : Listed1 (',' Listed1)* ','?
Listed1 : Expr | Star
Element : Named | Star
Star : @py3 '*' Bit
Named : Expr | @py3 ID ':=' Expr
Expr : Logic ('if' Logic 'else' Expr)? | Lambda
Lambda : 'lambda' LambdaParameters? ':' Expr
LambdaParameters : LambdaPositional (',' LambdaStarred)? ','? | LambdaStarred ','?
LambdaPositional : LambdaPlain (',' LambdaPlain)* (',' Slash)? (',' LambdaPlain)* (',' LambdaDefault)* | (LambdaPlain ',')* LambdaDefault (',' LambdaDefault)* ',' Slash (',' LambdaDefault)* | LambdaDefault (',' LambdaDefault)*
LambdaPlain : ID | @py2 (:TuplePlain:)
LambdaDefault : LambdaPlain '=' Expr
LambdaStarred : '*' ID (@py3 ',' LambdaKeywordOnly)* (',' '**' ID)? | @py3 '*' (',' LambdaKeywordOnly)+ (',' '**' ID)? | '**' ID
LambdaKeywordOnly : ID | LambdaDefault
Logic : Inversion (('and' | 'or') Inversion)*
Inversion : 'not'* Compared
Compared : Bit (Comparison Bit)*
Comparison : COMPARISON | 'in' | 'not' 'in' | 'is' 'not'? | @py2 '<>'
Bit : Factor (Arithmetic Factor)*
Arithmetic : OPERATOR | '*' | '**' | '/' | '-' | '+' | '|' | '>>' | @py3 '@'
Factor : ('-' | '+' | '~')* (@py3 'await')? Postfix
Postfix : Atom Trailer*
Trailer : '.' ID | (:Arguments:) | [:Subscripts:]
Atom : ID | Number | Strings | '...' | 'None' | 'True' | 'False' | (:Grouped:) | [:Listed:] | {:Mapped:} | @py2 BACKTICKS
Number : NUM | @py3 NEWNUM | @py2 OLDNUM
Strings : (STR | @py3 FSTR | @py2 OLDSTR)+ | BSTR+ | @py2 (STR | BSTR | OLDSTR)+
Grouped : (Named | Yield | Element ',' (Element (',' Element)* ','?)? | Named Clause+)?
Listed : (Element (',' Element)* ','? | Named Clause+ | @py2 Expr 'for' Targets 'in' Logic (',' Logic)+ ','? Clause*)?
Clause : (@py3 'async')? 'for' Targets 'in' Logic Condition*
Condition : 'if' Logic | @py2 'if' Lambda
Mapped : (Pair (',' Pair)* ','? | Element (',' Element)* ','? | Named Clause+ | Expr ':' Expr Clause+)?
Pair : Expr ':' Expr | @py3 '**' Bit
Arguments : (Positioned (',' Positioned)* (',' Keywords)? ','? | Keywords ','? | Named Clause+)?
Positioned : Named | '*' Expr
Keywords : Keyword (',' Keyword)* (',' Doubled)* | Doubled (',' Doubled)* | Keyword (',' Keyword)* ',' '**' Expr (',' Doubled)*
Keyword : ID '=' Expr | '*' Expr
Doubled : ID '=' Expr | '**' Expr
Subscripts : Subscript (',' (Subscript | StarIndex))* ','? | StarIndex (',' (Subscript | StarIndex))* ','?
StarIndex : @py3 '*' Expr
Subscript : Named | Expr? ':' Expr? (':' Expr?)?
Field : Expressions | Yield
"""

GO = """
File :: TopLevel
TopLevel : 'package' ID Stop | Import Stop | Declaration Stop | Function Stop | Stop
Stop : ';' | END
Import : 'import' (ImportSpec | (:ImportSpecs:))
ImportSpecs : (ImportSpec (';' ImportSpec)* ';'?)?
ImportSpec : (ID | '.')? STR
Declaration : 'var' (VarSpec | (:VarSpecs:)) | 'const' (VarSpec | (:VarSpecs:)) | 'type' (TypeSpec | (:TypeSpecs:))
VarSpecs : (VarSpec (';' VarSpec)* ';'?)?
VarSpec : ID (',' ID)* Type? ('=' Exprs)?
TypeSpecs : (TypeSpec (';' TypeSpec)* ';'?)?
TypeSpec : ID [:TypeParams:]? '='? Type
TypeParams : TypeParam (',' TypeParam)* ','?
TypeParam : ID (',' ID)* Constraint
Constraint : '~'? Type ('|' '~'? Type)*
Function : 'func' (:Params:)? ID [:TypeParams:]? Signature {:Block:}? 
Signature : (:Params:) Result?
Result : Type | (:Params:)
Params : (Param (',' Param)* ','?)?
Param : ID? '...'? Type
Type : Name [:Types:]? | '*' Type | [:Length:] Type | 'map' [:Type:] Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' Signature | 'struct' {:Fields:} | 'interface' {:Methods:} | (:Type:)
Types : Type (',' Type)* ','?
Name : ID ('.' ID)?
Length : (Expr | '...')?
Fields : (Field (';' Field)* ';'?)?
Field : (ID (',' ID)* Type | '*'? Name [:Types:]?) STR?
Methods : (Method (';' Method)* ';'?)?
Method : ID Signature | Constraint
Block :: Line
Line : Statement? Stop | Stop
Statement : Declaration | ID ':' Statement? | SimpleStatement | 'return' Exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | 'go' Expr | 'defer' Expr | {:Block:} | If | Switch | Select | For
SimpleStatement : Expr | Exprs ('=' | ':=' | ASSIGN) Exprs | Expr ('++' | '--') | Expr '<-' Expr
If : 'if' (SimpleStatement? ';')? SimpleStatement {:Block:} ('else' (If | {:Block:}))?
Switch : 'switch' (SimpleStatement? ';')? SimpleStatement? {:Cases:}
Cases : Case* END?
Case : ('case' CaseList | 'default') ':' Line*
CaseList : CaseItem (',' CaseItem)*
CaseItem : Expr | Type
Select : 'select' {:Comms:}
Comms : Comm* END?
Comm : ('case' SimpleStatement | 'default') ':' Line*
For : 'for' {:Block:} | 'for' SimpleStatement {:Block:} | 'for' SimpleStatement? ';' Expr? ';' SimpleStatement? {:Block:} | 'for' (Exprs ('=' | ':='))? 'range' Expr {:Block:}
Exprs : Expr (',' Expr)*
Expr : Unary (Operator Unary)*
Operator : OPERATOR | '*' | '|' | '<-'
Unary : ('-' | '+' | '!' | '^' | '*' | '&' | '<-' | '~')* Primary
Primary : Operand Suffix*
Operand : ID | NUM | STR | CHAR | (:Expr:) | (:Type:) | 'func' Signature {:Block:} | CompositeType {:Literal:} | [:Length:] Type | 'map' [:Type:] Type | 'chan' Type | 'struct' {:Fields:} | 'interface' {:Methods:}
CompositeType : [:Length:] Type | 'map' [:Type:] Type | 'struct' {:Fields:}
Suffix : '.' ID | '.' (:Asserted:) | [:Index:] | (:Arguments:) | {:Literal:}
Asserted : Type | 'type'
Index : Expr | Expr? ':' Expr? (':' Expr)? | Types
Arguments : (Argument (',' Argument)* '...'? ','?)?
Argument : Expr | Type
Literal : (Entry (',' Entry)* ','?)?
Entry : Value (':' Value)?
Value : Expr | {:Literal:}
"""

JAVA = """
File :: TopLevel
TopLevel : Annotation* 'package' Dotted ';' | 'import' 'static'? Dotted ('.' '*')? ';' | 'import' 'module' Dotted ';' | TypeDeclaration | ';' | Annotation* 'open'? 'module' Dotted {:ModuleBody:}
ModuleBody : Directive*
Directive : ID+ Dotted (ID Dotted (',' Dotted)*)? ';' | ID 'static' Dotted ';'
Dotted : ID ('.' ID)*
Modifier : MODIFIER | 'static' | 'default' | 'synchronized' | 'final' | 'sealed' | 'non' '-' 'sealed' | Annotation
Annotation : '@' Dotted (:AnnotationArguments:)?
AnnotationArguments : (AnnotationValue | AnnotationPair (',' AnnotationPair)*)?
AnnotationPair : ID '=' AnnotationValue
AnnotationValue : Expr | Annotation | {:AnnotationValues:}
AnnotationValues : (AnnotationValue (',' AnnotationValue)*)? ','?
TypeDeclaration : Modifier* (Class | Interface | Enum | Record | '@' 'interface' ID {:Members:})
Class : 'class' ID TypeParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? {:Members:}
Interface : 'interface' ID TypeParams? ('extends' Types)? ('permits' Types)? {:Members:}
Enum : 'enum' ID ('implements' Types)? {:EnumBody:}
EnumBody : (Constant (',' Constant)* ','?)? (';' Member*)?
Constant : Annotation* ID (:Arguments:)? {:Members:}?
Record : 'record' ID TypeParams? (:Params:) ('implements' Types)? {:Members:}
Members :: Member
Member : TypeDeclaration | Method | Field | 'static'? {:Block:} | ';'
Method : Modifier* TypeParams? Annotation* (ResultType ID | ID) (:Params:) Dims? ('throws' Types)? ({:Block:} | 'default' AnnotationValue ';' | ';') | Modifier* ID {:Block:}
ResultType : 'void' | Type
Field : Modifier* Type Declarators ';'
Declarators : Declarator (',' Declarator)*
Declarator : ID Dims? ('=' Initialiser)?
Initialiser : Expr | {:Initialisers:}
Initialisers : (Initialiser (',' Initialiser)*)? ','?
Params : (Param (',' Param)*)?
Param : ('final' | Annotation)* Type Annotation* '...'? (ID Dims? | ID? '.'? 'this')
Types : Type (',' Type)*
Type : Annotation* (PRIMITIVE | Reference) Dims?
Dims : (Annotation* [:Nothing:])+
Nothing : 
Reference : ID TypeArgs? ('.' Annotation* ID TypeArgs?)*
TypeArgs : '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg : Type | Annotation* '?' (('extends' | 'super') Type)?
TypeParams : '<' TypeParam (',' TypeParam)* '>'
TypeParam : Annotation* ID ('extends' Type ('&' Type)*)?
Block :: Statement
Statement : {:Block:} | Local ';' | TypeDeclaration | Expr ';' | ';' | ID ':' Statement | If | 'while' (:Expr:) Statement | 'do' Statement 'while' (:Expr:) ';' | 'for' (:ForControl:) Statement
 | 'return' Expr? ';' | 'break' ID? ';' | 'continue' ID? ';' | 'throw' Expr ';' | 'synchronized' (:Expr:) {:Block:} | 'assert' Expr (':' Expr)? ';' | 'yield' Expr ';' | Try | Switch
If : 'if' (:Expr:) Statement ('else' Statement)?
Local : ('final' | Annotation)* Type Declarators
ForControl : (Local | Exprs)? ';' Expr? ';' Exprs? | ('final' | Annotation)* Type ID ':' Expr
Exprs : Expr (',' Expr)*
Try : 'try' (:Resources:)? {:Block:} Catch* ('finally' {:Block:})?
Resources : Resource (';' Resource)* ';'?
Resource : Local | Primary
Catch : 'catch' (:CatchParam:) {:Block:}
CatchParam : ('final' | Annotation)* Type ('|' Type)* ID
Switch : 'switch' (:Expr:) {:SwitchBody:}
SwitchBody : Group* | Arrow*
Group : Label+ Statement*
Label : ('case' CaseItem (',' CaseItem)* | 'default') ':'
Arrow : ('case' CaseItem (',' CaseItem)* Guard? | 'default') '->' (Expr ';' | {:Block:} | 'throw' Expr ';')
CaseItem : Ternary | 'default' | PatternCase
Guard : 'when' Expr
PatternCase : ('final' | Annotation)* Type ID? (:PatternList:)? ID?
PatternList : (PatternCase (',' PatternCase)*)?
Expr : Ternary (Assign Expr)? | Lambda
Assign : ASSIGN | '=' | '>' '>' '=' | '>' '>' '>' '=' 
Lambda : (ID | (:LambdaParams:)) '->' (Expr | {:Block:})
LambdaParams : (ID (',' ID)*)? | Params
Ternary : Binary ('?' Expr ':' (Lambda | Ternary))?
Binary : Unary (Operator Unary | 'instanceof' 'final'? PatternCase)*
Operator : OPERATOR | '<' | '>' | '>' '=' | '>' '>' | '>' '>' '>' | '&' | '-'
Unary : (PREFIX | '-')* Postfix | (PREFIX | '-')* (:CastType:) Unary | (PREFIX | '-')* (:CastType:) Lambda
CastType : Type ('&' Type)*
Postfix : Primary ('++' | '--')*
Primary : Start Suffix*
Start : ID | NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | (:Expr:) | New | Switch | (PRIMITIVE | Reference) Dims? '.' 'class' | 'void' '.' 'class' | (Reference | PRIMITIVE) Dims? '::' (ID | 'new')
Suffix : '.' TypeArgs? ID | '.' 'class' | '.' 'this' | '.' 'super' | '.' New | (:Arguments:) | [:Expr:] | '::' TypeArgs? (ID | 'new')
New : 'new' TypeArgs? Annotation* Reference (:Arguments:) {:Members:}? | 'new' Annotation* (PRIMITIVE | Reference) ([:Expr:] | [:Nothing:])+ {:Initialisers:}?
Arguments : (Expr (',' Expr)*)?
"""

JAVASCRIPT = """
File :: Statement
Block :: Statement
Statement : {:Block:} | Variables Stop | Function | Class | ';' | END | ^ Expr Stop | If | For | 'while' (:Expr:) Statement | 'do' Statement 'while' (:Expr:) Stop?
 | 'return' Expr? Stop | 'break' ID? Stop | 'continue' ID? Stop | 'throw' Expr Stop | Try | Switch | ID ':' Statement | 'import' ImportClause Stop | Export | 'debugger' Stop | 'with' (:Expr:) Statement
 | @ts Declaration | Decorator Statement | HASHBANG
Stop : ';' | END
Decorator : DECORATOR (:Arguments:)?
Variables : ('var' | 'let' | 'const') Binding (',' Binding)* | @ts 'declare' Variables
Binding : Pattern '!'? Annotation? ('=' Assignment)?
Annotation : @ts ':' Type
Pattern : ID | [:ArrayPattern:] | {:ObjectPattern:}
ArrayPattern : (Slot? (',' Slot?)*)?
Slot : '...'? Pattern ('=' Assignment)?
ObjectPattern : (Property (',' Property)* ','?)?
Property : ID ('=' Assignment)? | Key ':' Pattern ('=' Assignment)? | '...' Pattern
Key : ID | WORD | STR | NUM | [:Assignment:] | PRIVATE
Function : 'async'? 'function' '*'? ID? Callable | @ts 'declare' Function
Callable : TypeParams? (:Params:) Result? {:Block:} | @ts TypeParams? (:Params:) Result? Stop?
Result : @ts ':' Returned
Returned : Type | 'asserts'? (ID | 'this') ('is' Type)?
Params : (Param (',' Param)* ','?)?
Param : Decorator* Access* '...'? Pattern '?'? Annotation? ('=' Assignment)? | @ts 'this' Annotation
Access : @ts ACCESS | @ts 'readonly' | @ts 'override'
Class : @ts 'abstract' Class | @ts 'declare' Class | 'class' ID? TypeParams? ('extends' Heritage)? Implements? {:Members:}
Heritage : Left TypeArgs?
Implements : @ts 'implements' Types
Members :: MemberItem
MemberItem : Member | ';' | END
Member : Decorator* MemberModifier* (MemberMethod | MemberField | 'static' {:Block:} | @ts [:IndexKey:] Annotation MemberStop)
MemberModifier : 'static' | 'async' | 'get' | 'set' | '*' | 'accessor' | @ts ACCESS | @ts 'readonly' | @ts 'abstract' | @ts 'override' | @ts 'declare'
MemberMethod : Key '?'? TypeParams? (:Params:) Result? ({:Block:} | MemberStop)
MemberField : Key ('?' | '!')? Annotation? ('=' Assignment)? MemberStop
MemberStop : ';' | ',' | END
IndexKey : ID ':' Type
If : 'if' (:Expr:) Statement ('else' Statement)?
For : 'for' 'await'? (:ForControl:) Statement
ForControl : (Variables | Expr)? ';' Expr? ';' Expr? | (('var' | 'let' | 'const') Pattern Annotation? | Left) ('in' | 'of') Expr
Try : 'try' {:Block:} ('catch' (:CatchParam:)? {:Block:})? ('finally' {:Block:})?
CatchParam : Pattern Annotation?
Switch : 'switch' (:Expr:) {:Cases:}
Cases : Case* END?
Case : ('case' Expr | 'default') ':' Statement*
ImportClause : STR With? | @ts 'type' ImportNames 'from' STR | ImportNames 'from' STR With? | @ts ID '=' Expr
With : ('with' | 'assert') {:Pairs:}
ImportNames : ID | {:Names:} | '*' 'as' ID | ID ',' ({:Names:} | '*' 'as' ID)
Names : (Name (',' Name)* ','?)?
Name : 'type'? (ID | WORD | STR) ('as' (ID | WORD | STR))?
Export : 'export' ({:Names:} ('from' STR)? Stop | '*' ('as' (ID | WORD | STR))? 'from' STR Stop | 'default' (Function | Class | Expr Stop) | Variables Stop | Decorator* 'async'? Function | Decorator* Class | @ts Declaration | @ts 'type' {:Names:} ('from' STR)? Stop | @ts '=' Expr Stop | @ts 'default' Declaration)
Declaration : 'declare'? (Interface | Alias Stop | Enum | Namespace) | 'declare' 'global' {:Block:}
Interface : 'interface' ID TypeParams? ('extends' Types)? {:TypeMembers:}
Alias : 'type' ID TypeParams? '=' Type
Enum : 'const'? 'enum' ID {:EnumMembers:}
EnumMembers : (Key ('=' Assignment)? (',' Key ('=' Assignment)?)* ','?)?
Namespace : ('namespace' | 'module') (ID ('.' ID)* | STR) ({:Block:} | Stop)
Types : Type (',' Type)*
Type : '|'? '&'? Joined ('extends' Joined '?' Type ':' Type)? | 'new'? TypeParams? (:TypeArguments:) '=>' Returned | 'abstract' 'new' (:TypeArguments:) '=>' Type
Joined : Prefixed (('|' | '&') Prefixed)*
Prefixed : ('keyof' | 'readonly' | 'unique' | 'infer' | 'typeof')* Basic ([:Type:] | [:Nothing:])*
Nothing : 
Basic : ID TypeArgs? ('.' (ID | WORD) TypeArgs?)* | STR | NUM | '-' NUM | 'this' | 'null' | 'undefined' | 'void' | 'true' | 'false' | TEMPLATE | {:TypeMembers:} | [:Tuple:] | (:Type:) | 'import' (:Arguments:) ('.' ID)* TypeArgs?
Tuple : (TupleItem (',' TupleItem)* ','?)?
TupleItem : '...'? (ID '?'? ':')? Type '?'?
TypeArgs : '<' Type (',' Type)* '>'
TypeParams : @ts '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam : ('const' | 'in' | 'out')* ID ('extends' Type)? ('=' Type)?
TypeArguments : (TypeArgument (',' TypeArgument)* ','?)?
TypeArgument : '...'? (Pattern | 'this') '?'? Annotation?
TypeMembers : (TypeMember (MemberStop+ TypeMember)* MemberStop*)?
TypeMember : ('readonly' | 'get' | 'set' | '-' | '+')* (Key | [:IndexKey:] | [:MappedKey:]) ('-'? '?')? (TypeParams? (:TypeArguments:))? (':' Returned)? | 'new'? TypeParams? (:TypeArguments:) (':' Returned)?
MappedKey : ID 'in' Type ('as' Type)?
Expr : Assignment (',' Assignment)*
Assignment : Conditional | Left Assign Assignment | Arrow | 'yield' ('*'? Assignment)? | 'async' Arrow
Assign : ASSIGN | '=' | '>' '>' '=' | '>' '>' '>' '='
Arrow : (ID | TypeParams? (:Params:) Result?) '=>' (Assignment | {:Block:})
Conditional : Binary ('?' Assignment ':' Assignment)?
Binary : Unary (Operator Unary | @ts ('as' | 'satisfies') (Type | 'const'))*
Operator : OPERATOR | '<' | '>' | '>' '=' | '>' '>' | '>' '>' '>' | '&' | '|' | '*' | '-' | '+' | 'in' | 'instanceof'
Unary : (PREFIX | '-' | '+' | 'typeof' | 'void' | 'await' | '!')* Postfix | @ts '<' Type '>' Unary
Postfix : Left ('++' | '--')?
Left : Start Suffix*
Start : ID | NUM | STR | TEMPLATE | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | 'undefined' | (:Expr:) | [:Elements:] | {:Pairs:} | 'async'? 'function' '*'? ID? TypeParams? (:Params:) Result? {:Block:} | Decorator* 'class' ID? TypeParams? ('extends' Heritage)? Implements? {:Members:}
 | 'new' Left | 'new' '.' ID | 'import' (:Arguments:) | 'import' '.' ID | PRIVATE
Suffix : ('.' | '?.') (ID | WORD | PRIVATE) | '?.'? [:Expr:] | '?.'? (:Arguments:) | TEMPLATE | @ts '!' | @ts TypeArgs (:Arguments:) | @ts TypeArgs TEMPLATE
Arguments : (Argument (',' Argument)* ','?)?
Argument : '...'? Assignment
Elements : (Argument? (',' Argument?)*)?
Pairs : (Pair (',' Pair)* ','?)?
Pair : Key ':' Assignment | ID ('=' Assignment)? | '...' Assignment | ('async' | 'get' | 'set' | '*')* Key TypeParams? (:Params:) Result? {:Block:}
"""

RUST = """
File :: Item
Item : INNER | Attribute* Visibility? Plain | ';' | END
Attribute : '#' [:Anything:]
Anything : Token*
Token : ANY | (:Anything:) | [:Anything:] | {:Anything:}
Visibility : 'pub' (:VisibilityScope:)?
VisibilityScope : 'crate' | 'self' | 'super' | 'in' Path
Plain : Function | 'struct' ID Generics? Where? {:Fields:} | 'struct' ID Generics? ((:TupleFields:))? Where? Stop | 'enum' ID Generics? Where? {:Variants:} | 'union' ID Generics? Where? {:Fields:}
 | 'unsafe'? 'impl' Generics? 'const'? ('!'? Type 'for')? Type Where? {:Members:} | 'unsafe'? 'auto'? 'trait' ID Generics? (':' Bounds)? Where? {:Members:} | 'type' ID Generics? (':' Bounds)? Where? ('=' Type)? Where? Stop
 | 'use' UseTree Stop | 'mod' ID ({:File:} | Stop) | 'const' (ID | '_') ':' Type ('=' Expr)? Stop | 'static' 'mut'? ID ':' Type ('=' Expr)? Stop | 'extern' 'crate' ID ('as' ID)? Stop | 'unsafe'? 'extern' STR? {:Members:}
 | Path '!' ID? ({:Anything:} | (:Anything:) Stop | [:Anything:] Stop)
Stop : ';' | END
Function : ('const' | 'async' | 'unsafe' | 'default' | 'extern' STR?)* 'fn' ID Generics? (:Params:) ('->' Type)? Where? ({:Block:} | Stop)
Params : (Param (',' Param)* ','?)?
Param : Attribute* ('&' LIFETIME? 'mut'? 'self' | 'mut'? 'self' (':' Type)? | Pattern ':' (Type | '...') | '...')
Generics : '<' (Generic (',' Generic)* ','?)? '>'
Generic : Attribute* (LIFETIME (':' LifetimeBounds)? | ID (':' Bounds?)? ('=' Type)? | 'const' ID ':' Type ('=' Expr)?)
LifetimeBounds : LIFETIME ('+' LIFETIME)*
Where : 'where' (Condition (',' Condition)* ','?)?
Condition : ('for' Generics)? Type ':' Bounds? | LIFETIME ':' LifetimeBounds
Bounds : Bound ('+' Bound)* '+'?
Bound : LIFETIME | '?'? '~'? 'const'? ('for' Generics)? TypePath | (:Bound:)
Fields : (Field (',' Field)* ','?)?
Field : Attribute* Visibility? ID ':' Type
TupleFields : (TupleField (',' TupleField)* ','?)?
TupleField : Attribute* Visibility? Type
Variants : (Variant (',' Variant)* ','?)?
Variant : Attribute* Visibility? ID ({:Fields:} | (:TupleFields:))? ('=' Expr)?
Members :: Item
UseTree : '::'? (Segment '::')* (Segment ('as' (ID | '_'))? | '*' | {:UseTrees:})
UseTrees : (UseTree (',' UseTree)* ','?)?
Segment : ID | 'self' | 'super' | 'crate'
Path : '::'? Segment ('::' Segment)*
TypePath : '::'? TypeSegment ('::' TypeSegment)* | '<' Type ('as' TypePath)? '>' ('::' TypeSegment)+
TypeSegment : (Segment | 'Self') ('::'? GenericArgs)? | (Segment | 'Self') (:Types:) ('->' Type)?
GenericArgs : '<' (GenericArg (',' GenericArg)* ','?)? '>'
GenericArg : LIFETIME | Type | ID '=' Type | ID ':' Bounds | NUM | '-' NUM | {:Block:} | 'true' | 'false' | STR | CHAR
Types : (Type (',' Type)* ','?)?
Type : TypePath | '&' LIFETIME? 'mut'? Type | '&&' LIFETIME? 'mut'? Type | '*' ('const' | 'mut') Type | (:Types:) | [:ArrayType:] | '!' | '_' | ('for' Generics)? ('unsafe' | 'extern' STR?)* 'fn' (:FnTypes:) ('->' Type)? | 'impl' Bounds | 'dyn' Bounds | Path '!' (:Anything:)
FnTypes : (FnType (',' FnType)* ','?)?
FnType : ((ID | '_') ':')? Type | '...'
ArrayType : Type (';' Expr)?
Block :: Statement
Statement : ';' | END | INNER | Item | Attribute* 'let' Pattern (':' Type)? ('=' Expr ('else' {:Block:})?)? Stop | Attribute* Expr Stop | Attribute* BlockLike
BlockLike : (LIFETIME ':')? (If | 'match' Expr {:Arms:} | ('unsafe' | 'async' 'move'? | 'const')? {:Block:} | 'loop' {:Block:} | 'while' Expr {:Block:} | 'for' Pattern 'in' Expr {:Block:})
If : 'if' Expr {:Block:} ('else' (If | {:Block:}))?
Arms : Arm* END?
Arm : Attribute* Pattern ('if' Expr)? '=>' (Expr ',' | Expr END | BlockLike ','?)
Pattern : '|'? Single ('|' Single)*
Single : '_' | '..' | ('ref' | 'mut')* ID ('@' Pattern)? | Literal | Literal? RANGE Literal? | PatternPath ((:Patterns:) | {:FieldPatterns:})? | '&' 'mut'? Single | '&&' 'mut'? Single | (:Patterns:) | [:Patterns:] | Path '!' (:Anything:) | 'box' Single | 'const' {:Block:}
PatternPath : '::'? PatternSegment ('::' PatternSegment)* | '<' Type ('as' TypePath)? '>' ('::' PatternSegment)+
PatternSegment : (Segment | 'Self') ('::' GenericArgs)?
Patterns : (Pattern (',' Pattern)* ','?)?
FieldPatterns : (FieldPattern (',' FieldPattern)* ','?)?
FieldPattern : Attribute* (('ref' | 'mut')* ID | (ID | NUM) ':' Pattern | '..')
Literal : '-'? NUM | STR | CHAR | 'true' | 'false' | PatternPath
Expr : Operand (Operator Operand)* | Operand? RANGE (Operand (Operator Operand)*)? | 'return' Expr? | 'break' LIFETIME? Expr? | 'continue' LIFETIME? | Closure
Operand : ('-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'? | '&' 'raw' ('const' | 'mut'))* Postfix ('as' Type)* | ('-' | '!' | '*' | '&')* (Closure | 'return' Expr? | 'break' LIFETIME? Expr? | 'continue' LIFETIME?) | 'let' Pattern '=' Operand
Closure : ('move' | 'async' | 'static')* ('||' | '|' ClosureParams? '|') ('->' Type {:Block:} | Expr)
ClosureParams : ClosureParam (',' ClosureParam)* ','?
ClosureParam : Single (':' Type)?
Operator : OPERATOR | '=' | '<' | '>' | '>' '=' | '>' '>' | '>' '>' '=' | '&' | '&&' | '|' | '||' | '*' | '-' | '+' | '!='
Postfix : Start Suffix*
Suffix : '?' | '.' (ID | NUM | 'await') ('::' GenericArgs)? | (:Arguments:) | [:Expr:]
Start : NUM | STR | CHAR | 'true' | 'false' | 'self' | ExprPath {:FieldValues:}? | (:Grouped:) | [:Elements:] | BlockLike | Path '!' ((:Anything:) | [:Anything:] | {:Anything:})
ExprPath : '::'? ExprSegment ('::' ExprSegment)* | '<' Type ('as' TypePath)? '>' ('::' ExprSegment)+
ExprSegment : (Segment | 'Self') ('::' GenericArgs)?
Grouped : (Expr (',' Expr)* ','?)?
Elements : (Expr (',' Expr)* ','?)? | Expr ';' Expr
Arguments : (Expr (',' Expr)* ','?)?
FieldValues : (FieldValue (',' FieldValue)* ','?)?
FieldValue : Attribute* ((ID | NUM) ':' Expr | ID | '..' Expr?)
"""

CFAMILY = """
File :: External
External : Declaration | FunctionDefinition | ';' | END | ASM (:Anything:) ';' | 'extern' STR ({:File:} | External) | @cpp Namespace | @cpp Template | @cpp 'using' UsingRest ';' | 'static_assert' (:Arguments:) ';' | ID (:Arguments:) ';'? | @cpp 'concept' ID '=' Expr ';' | @cpp 'export'? ('import' | 'module') Dotted? ';'
Dotted : ID ('.' ID)*
Anything : Token*
Token : ANY | (:Anything:) | [:Anything:] | {:Anything:}
Namespace : 'inline'? 'namespace' Attribute* (Qualified)? {:File:} | 'namespace' ID '=' Qualified ';'
UsingRest : 'namespace' Qualified | 'typename'? Qualified (',' Qualified)* | ID Attribute* '=' TypeId | 'enum' Qualified
Template : 'template' ('<' (TemplateParam (',' TemplateParam)*)? '>')? Requires? (External | Member)
TemplateParam : ('typename' | 'class') '...'? ID? ('=' TypeId)? | 'template' '<' (TemplateParam (',' TemplateParam)*)? '>' ('class' | 'typename') ID? ('=' TypeId)? | Param | Qualified '...'? ID ('=' TypeId)?
Requires : 'requires' Operand (OPERATOR Operand)*
Attribute : [:Anything:] | ATTRIBUTE (:Anything:)?
Specifier : SPECIFIER | 'static' | 'extern' | 'inline' | 'const' | 'volatile' | 'typedef' | ATTRIBUTE (:Anything:)? | [:AttributeInside:] | @cpp 'constexpr' | @cpp 'explicit' (:Expr:)? | @cpp 'virtual' | @cpp 'friend' | @cpp 'mutable' | @cpp 'constinit' | @cpp 'consteval' | @cpp 'thread_local' | 'alignas' (:Anything:)
AttributeInside : [:Anything:]
Declaration : Specifier* TypeSpecifier (Specifier | BUILTIN)* InitDeclarators? ';'
TypeSpecifier : BUILTIN+ | Struct | EnumType | Qualified | @cpp 'auto' | @cpp 'decltype' (:Expr:) | 'typeof' (:Anything:) | @cpp 'typename' Qualified
Struct : ('struct' | 'union' | @cpp 'class') Attribute* Specifier* Qualified? 'final'? Bases? {:Members:} | ('struct' | 'union' | @cpp 'class') Attribute* Qualified
Bases : @cpp ':' Base (',' Base)*
Base : ('virtual' | ACCESS)* Qualified '...'?
EnumType : 'enum' (@cpp 'class' | @cpp 'struct')? Attribute* Qualified? (@cpp ':' BUILTIN+ | @cpp ':' Qualified)? {:Enumerators:} | 'enum' (@cpp 'class' | @cpp 'struct')? Qualified (@cpp ':' BUILTIN+ | @cpp ':' Qualified)?
Enumerators : (Enumerator (',' Enumerator)* ','?)?
Enumerator : ID Attribute* ('=' Ternary)?
Qualified : '::'? Named ('::' 'template'? Named)*
Named : ID TemplateArgs? | @cpp '~' ID | @cpp 'operator' OperatorName
TemplateArgs : @cpp '<' (TemplateArg (',' TemplateArg)*)? '>'
TemplateArg : (TypeId | Additive) '...'?
OperatorName : OPERATOR | ASSIGN | '=' | '<' | '>' | '>' '=' | '>' '>' | '*' | '&' | '-' | '+' | '!' | '~' | '++' | '--' | ',' | '->' | '&&' | (:Nothing:) | [:Nothing:] | 'new' [:Nothing:]? | 'delete' [:Nothing:]? | TypeId | STR ID
Nothing : 
InitDeclarators : InitDeclarator (',' InitDeclarator)*
InitDeclarator : Declarator (ASM (:Anything:))? Attribute* ('=' Initialiser | @cpp (:Arguments:) | @cpp {:Initialisers:} | ':' Ternary ('=' Initialiser)?)? | ':' Ternary
Declarator : Pointer* Direct | @cpp Pointer* '...'? Direct
Pointer : ('*' | '&' | '&&' | Qualified '::' '*') ('const' | 'volatile' | SPECIFIER)*
Direct : (Qualified | (:Declarator:)) DirectSuffix* | @cpp [:Structured:]
Structured : ID (',' ID)*
DirectSuffix : [:ArrayBound:] | (:Params:) FunctionTail*
FunctionTail : @cpp 'const' | @cpp 'volatile' | @cpp '&' | @cpp '&&' | @cpp 'noexcept' (:Expr:)? | @cpp 'override' | @cpp 'final' | @cpp '->' TypeId | ATTRIBUTE (:Anything:)? | @cpp 'throw' (:Arguments:) | @cpp Requires | @cpp [:AttributeInside:]
ArrayBound : ('static' | 'const' | SPECIFIER)* Assignment? | '*'
Params : (Param (',' Param)* (',' '...')?)? | '...' | Param '...' | ID (',' ID)*
Param : Specifier* TypeSpecifier (Specifier | BUILTIN)* ParamDeclarator? ('=' Initialiser)?
ParamDeclarator : Pointer* '...'? Direct | Pointer* '...'? Abstract | Pointer+ '...'?
Abstract : [:ArrayBound:]+ | (:AbstractInside:) ([:ArrayBound:] | (:Params:) FunctionTail*)* | (:Params:)
AbstractInside : Pointer+ Qualified? [:ArrayBound:]* | Pointer+ (:Params:)
TypeId : Specifier* TypeSpecifier (Specifier | BUILTIN)* (Pointer* Abstract | Pointer+)?
FunctionDefinition : Specifier* (TypeSpecifier (Specifier | BUILTIN)*)? Declarator Declaration* FunctionBody
FunctionBody : {:Block:} | @cpp ':' MemberInit (',' MemberInit)* {:Block:} | @cpp 'try' {:Block:} Catch+ | @cpp '=' ('default' | 'delete' | NUM) ';'
MemberInit : Qualified ((:Arguments:) | {:Initialisers:}) '...'?
Members :: Member
Member : Declaration | FunctionDefinition | ';' | END | @cpp ACCESS ':' | @cpp Template | @cpp 'using' UsingRest ';' | @cpp 'friend' (Struct | TypeSpecifier) ';' | 'static_assert' (:Arguments:) ';' | @cpp Specifier* Declarator ('=' NUM)? ';'
Initialiser : Assignment | {:Initialisers:}
Initialisers : (Designated (',' Designated)* ','?)?
Designated : (Designator+ '='?)? Initialiser '...'?
Designator : '.' ID | [:Ternary:] | [:RangeBound:] | ID ':'
RangeBound : Ternary '...' Ternary
Block :: Statement
Statement : {:Block:} | Declaration | Expr ';' | ';' | END | 'if' @cpp 'constexpr' (:Condition:) Statement ('else' Statement)? | 'if' (:Condition:) Statement ('else' Statement)? | 'while' (:Condition:) Statement | 'do' Statement 'while' (:Expr:) ';' | 'for' (:ForControl:) Statement | 'switch' (:Condition:) Statement
 | 'case' Ternary ('...' Ternary)? ':' Statement? | 'default' ':' Statement? | ID ':' Statement? | 'goto' (ID | '*' Expr) ';' | 'break' ';' | 'continue' ';' | 'return' (Expr | {:Initialisers:})? ';' | ASM (:Anything:) ';' | 'static_assert' (:Arguments:) ';' | FunctionDefinition
 | @cpp 'try' {:Block:} Catch+ | @cpp 'throw' Expr? ';' | @cpp 'using' UsingRest ';' | @cpp 'co_return' Expr? ';' | [:AttributeInside:] Statement | @cpp Namespace
Condition : Expr | @cpp (Declaration | Expr ';') Expr | @cpp Specifier* TypeSpecifier Specifier* Declarator ('=' Initialiser | {:Initialisers:})
ForControl : (Declaration | Expr? ';') Expr? ';' Expr? | @cpp (Declaration | Expr ';')? Specifier* TypeSpecifier Specifier* Declarator ':' Initialiser
Catch : 'catch' (:CatchParam:) {:Block:}
CatchParam : Param | '...'
Expr : Assignment (',' Assignment)*
Assignment : Ternary | Unary Assign (Assignment | {:Initialisers:}) | @cpp 'throw' Assignment? | @cpp 'co_yield' Assignment
Assign : ASSIGN | '=' | '>' '>' '='
Ternary : Binary ('?' Expr? ':' Assignment)?
Binary : Unary (Operator Unary)*
Operator : OPERATOR | '<' | '>' | '>' '=' | '>' '>' | '&' | '&&' | '*' | '-' | '+' | @cpp '->*' | @cpp '.*'
Additive : Unary ((OPERATOR | '&' | '&&' | '*' | '-' | '+') Unary)*
Operand : Unary
Unary : Prefix* Postfix | Prefix* (:TypeId:) Unary | Prefix* 'sizeof' '...'? (:TypeId:) | Prefix* 'sizeof' (:TypeId:) {:Initialisers:} | Prefix* 'alignof' (:TypeId:)
Prefix : '-' | '+' | '!' | '~' | '*' | '&' | '&&' | '++' | '--' | 'sizeof' | '__extension__' | @cpp 'co_await' | @cpp 'delete' [:Nothing:]? | @cpp '::' 'delete'
Postfix : Start Suffix*
Start : Qualified | (:TypeId:) {:Initialisers:} | NUM | Strings | CHAR | 'true' | 'false' | 'nullptr' | 'this' | (:Expr:) | (:StatementExpr:) | @cpp New | @cpp Lambda | @cpp CAST '<' TypeId '>' (:Expr:) | @cpp BUILTIN+ ((:Arguments:) | {:Initialisers:}) | @cpp Qualified {:Initialisers:} | @cpp 'typename' Qualified ((:Arguments:) | {:Initialisers:}) | @cpp (:Fold:) | 'va_arg' (:VaArg:) | 'offsetof' (:VaArg:) | @cpp 'typeid' ((:TypeId:) | (:Expr:)) | @cpp 'noexcept' (:Expr:) | @cpp 'requires' (:Params:)? {:Anything:} | 'generic' (:Anything:) | @cpp 'decltype' (:Expr:) | @cpp 'auto' ((:Arguments:) | {:Initialisers:})
Strings : ID? STR (STR | ID STR?)*
StatementExpr : {:Block:}
VaArg : Assignment ',' TypeId | TypeId ',' Assignment
Fold : Unary? (Operator | ASSIGN | ',') '...' ((Operator | ASSIGN | ',') Unary)? | '...' (Operator | ',') Unary
New : '::'? 'new' (:Arguments:)? (NewType | (:TypeId:)) ((:Arguments:) | {:Initialisers:})?
NewType : Specifier* TypeSpecifier Pointer* [:Assignment:]*
Lambda : [:Captures:] ('<' TemplateParam (',' TemplateParam)* '>')? ((:Params:) LambdaTail*)? {:Block:}
LambdaTail : 'mutable' | 'constexpr' | FunctionTail
Captures : (Capture (',' Capture)*)? 
Capture : '=' | '&' | '&'? '...'? ID '...'? ('=' Initialiser)? | 'this' | '*' 'this'
Suffix : '.' 'template'? Qualified | '->' 'template'? Qualified | (:Arguments:) | [:Expr:] | '++' | '--' | '...'
Arguments : (Argument (',' Argument)*)?
Argument : (Assignment | {:Initialisers:} | TypeId) '...'?
"""


class Language(NamedTuple):
    """What it takes to recognise texts of one language."""

    grammar: Grammar
    lexer: object
    segments: object
    dialects: int
    #: Texts that a text stands for, all of which must be valid, by conditional directives.
    variants: object = None

    def fits(self, text: str) -> int:
        """The dialects in which a text without directives is valid, as a mask."""
        tokens = self.lexer(text)
        return 0 if tokens is None else self.grammar.accepts("File", tokens, PAIRS, self.segments) & self.dialects

    def accepts(self, text: str) -> bool:
        """Whether a text is valid in one of the dialects."""
        return all(self.fits(t) for t in (self.variants(text) if self.variants else (text,)))


def _words(text: str) -> list[str]:
    return text.split()


def _literals(grammar: Grammar) -> dict[str, str]:
    return {**grammar.literals, **{b: b for b in "()[]{}"}}


def _operators(tokens) -> str:
    return "|".join(re.escape(t) for t in sorted((t for t in tokens if not re.match(r"\w", t)), key=len, reverse=True))


def _statement_segments(grammar: Grammar, starters: str, joiners: str = "else", headers: str = ""):
    """Splitter of statement lists: behind ``;`` and, before a word that begins a statement, behind braces.

    Between one of the ``headers`` and its braces, ``;`` belongs to the header.
    """
    stop = grammar.alphabet.char(";")
    join = {grammar.alphabet.char(w) for w in _words(joiners)}
    start = {grammar.alphabet.char(w) for w in _words(starters)}
    head = {grammar.alphabet.char(w) for w in _words(headers)}
    do = grammar.alphabet.chars.get("do")
    fits = grammar._fits

    def split(text: str) -> list[str]:
        if do and do in text:
            return [text + END]
        out, at, last, pending = [], 0, len(text), False
        for i, c in enumerate(text):
            follow = text[i + 1] if i + 1 < last else ""
            if c in head:
                pending = True
            elif pending and c >= "\U000f0000" and fits[c][0] == "{":
                pending = False
            if c == stop:
                if follow not in join and not pending:
                    out.append(text[at : i + 1])
                    at = i + 1
            elif c >= "\U000f0000" and follow in start and fits[c][0] == "{":
                out.append(text[at : i + 1])
                at = i + 1
        if at < last:
            out.append(text[at:] + END)
        return out

    return split


def _tokens(skipped: str, kinds: str) -> re.Pattern:
    """Pattern of one token, or ``z`` at the end, with what is skipped before it; the token is the last named group."""
    return re.compile(rf"(?:{skipped})*+(?:{kinds}|(?P<z>\Z))", re.S)


def _whole(text: str) -> list[str]:
    return [text]


# JSON


@functools.cache
def json_language() -> Language:
    grammar = Grammar(JSON, ["json"])
    char = grammar.alphabet.char
    pattern = _tokens(r"[ \t\r\n]+", r'(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<n>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<o>[{}\[\],:]|true\b|false\b|null\b)|(?P<e>.)')
    known = {"s": char("STR"), "n": char("NUM")}
    literal = {**{b: b for b in "{}[]"}, ",": char(","), ":": char(":"), **{w: char(w) for w in ("true", "false", "null")}}

    def lexer(text: str) -> str | None:
        out = []
        for m in pattern.finditer(text):
            kind = m.lastgroup
            if kind == "o":
                out.append(literal[m[kind]])
            elif kind == "z":
                break
            elif kind == "e":
                return None
            else:
                out.append(known[kind])
        return "".join(out)

    return Language(grammar, lexer, _whole, grammar.all)


# Python


_PY_PLAIN = re.compile(r"(?:[^\\]|\\(?![xuUN])|\\x[0-9a-fA-F]{2})*+", re.S)
_PY_ESCAPED = re.compile(r"(?:[^\\]|\\[^xuUN]|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|\\N\{[^}\n]+\}|\\\Z)*+", re.S)
_PY_NUMBER = re.compile(r"0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:\d(?:_?\d)*+)?\.\d(?:_?\d)*+|\d(?:_?\d)*+\.?)(?:[eE][+-]?\d(?:_?\d)*+)?[jJ]?")
_PY_OLD_NUMBER = re.compile(r"0[0-7]+[lL]?|(?:0[xX][\da-fA-F]+|0[oO][0-7]+|0[bB][01]+|\d+)[lL]")
_PY_LEADING_ZERO = re.compile(r"0[\d_]*[1-9][\d_]*")
_PY_STRING = r"(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''|\"(?!\"\")(?:[^\"\\\r\n]|\\(?:\r\n|.))*+\"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|.))*+')"
# Literal text of an f-string up to a field, a wrong brace or the end, and of a format within a field.
_PY_LITERAL, _PY_SPEC = {}, {}
for _quote in ("'", '"', "'''", '"""'):
    _other = rf"{_quote[0]}(?!{_quote[1:]})" if len(_quote) == 3 else r"(?!)"
    _line = "" if len(_quote) == 3 else r"\r\n"
    _PY_LITERAL[_quote] = re.compile(rf"(?:[^{{}}\\{_quote[0]}{_line}]|\\(?:\r\n|[^{{}}])|\\(?=[{{}}])|{{{{|}}}}|{_other})*+", re.S)
    _PY_SPEC[_quote] = re.compile(rf"(?:[^{{}}{_quote[0]}{_line}]|{_other})*+", re.S)


@functools.cache
def python_language() -> Language:
    """Python 3 and 2. What only one of them knows is marked in the grammar; a token of one only has a class of its own."""
    soft = _words("match case type print exec _")
    operators = _words("% // & ^ <<")
    comparisons = _words("< > == >= <= !=")
    augmented = _words("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=")
    grammar = Grammar(PYTHON, ["py3", "py2"], {"ID": soft, "OPERATOR": operators, "COMPARISON": comparisons, "AUGMENTED": augmented})
    char = grammar.alphabet.char
    literal = _literals(grammar)
    ops = _operators([*literal])
    pattern = re.compile(
        r"(?P<w>[ \t\f]+|\\\r?\n|#[^\r\n]*)|(?P<l>\r\n|\n|\r)|(?P<f>(?i:fr?|rf|tr?|rt)(?:\"\"\"|'''|[\"']))"
        rf"|(?P<s>(?i:[rbu]{{0,2}}){_PY_STRING})"
        r"|(?P<n>(?:0[xXoObB][\da-fA-F_]+|(?:\d[\d_]*+(?:\.[\d_]*+)?+|\.\d[\d_]*+)(?:[eE][+-]?\d[\d_]*+)?)[jJlL]?(?![\w]))"
        rf"|(?P<i>[^\W\d]\w*)|(?P<b>`[^`\n]+`)|(?P<o>{ops})|(?P<e>.)",
        re.S,
    )
    new_line, identifier, ticks, formatted, old = (char(t) for t in ("NL", "ID", "BACKTICKS", "FSTR", "OLD"))
    string, old_string, byte_string, plain, new, octal = (char(t) for t in ("STR", "OLDSTR", "BSTR", "NUM", "NEWNUM", "OLDNUM"))
    words = {t: c for t, c in literal.items() if re.match(r"\w", t)}

    @functools.lru_cache(maxsize=4096)
    def number(text: str) -> str | None:
        if _PY_NUMBER.fullmatch(text) and not _PY_LEADING_ZERO.fullmatch(text):
            return new if "_" in text else plain
        return octal if _PY_OLD_NUMBER.fullmatch(text) else None

    def quoted(text: str) -> str | None:
        if text[0] in "\"'" and "\\" not in text:
            return string
        prefix = re.match(r"\w*", text)[0].lower()
        if "b" in prefix:
            if "u" in prefix or "r" not in prefix and not _PY_PLAIN.fullmatch(re.sub(r"\\[uUN]", "", text)):
                return None
            return byte_string if text.isascii() else old_string
        if prefix == "ur":
            return old_string
        if "r" in prefix:
            return string if prefix == "r" else None
        if _PY_ESCAPED.fullmatch(text, len(prefix)):
            return string
        return old_string if prefix == "" and _PY_PLAIN.fullmatch(re.sub(r"\\[uUN]", "", text)) else None

    debug = re.compile(r"=\s*(?:[:}]|!(?!=))")
    tail = re.compile(r"(?:=\s*)?(?:![ \t]*[^\W\d]\w*\s*)?([:}])")

    def field(text: str, at: int, quote: str) -> int | None:
        """End of a replacement field of an f-string, behind its closing brace; what it holds is recognised as an expression."""
        out, depth, last = [], 0, len(text)
        while at < last:
            m = pattern.match(text, at)
            kind, s = m.lastgroup, m[0]
            if kind == "f":
                at = f_string(text, m)
                if at is None:
                    return None
                out.append(formatted)
                continue
            if not depth and (s[0] in "}:" or s[0] == "!" and s != "!=" or s == "=" and debug.match(text, at)):
                break
            at = m.end()
            if kind in "wl":
                continue
            if kind == "o":
                depth += (s in "([{") - (s in ")]}")
                if depth < 0:
                    return None
                out.append(literal[s])
            else:
                c = words.get(s, identifier) if kind == "i" else quoted(s) if kind == "s" else number(s) if kind == "n" else None
                if c is None:
                    return None
                out.append(c)
        end = tail.match(text, at)
        if end is None or not grammar.accepts("Field", "".join(out), PAIRS, segments) & 1:
            return None
        at = end.end()
        while end[1] == ":":  # the format, with fields of its own
            at = _PY_SPEC[quote].match(text, at).end()
            if text[at : at + 1] == "}":
                return at + 1
            if text[at : at + 1] != "{" or (at := field(text, at + 1, quote)) is None:
                return None
        return at

    def f_string(text: str, m: re.Match) -> int | None:
        """End of an f-string that begins with a match, or None."""
        quote = m[0].lstrip("fFrRtT")
        raw, at = "r" in m[0].lower(), m.end()
        while True:
            begun = at
            at = _PY_LITERAL[quote].match(text, at).end()
            if not raw and "\\" in text[begun:at]:
                if text[at : at + 1] == "{" and re.search(r"(?<!\\)(?:\\\\)*\\N\Z", text[begun:at]):  # a named character
                    named = re.compile(r"\{[^}\n]+\}").match(text, at)
                    if named is None:
                        return None
                    at = named.end()
                    continue
                if not _PY_ESCAPED.fullmatch(text, begun, at):
                    return None
            if text.startswith(quote, at):
                return at + len(quote)
            if text[at : at + 1] != "{":
                return None
            at = field(text, at + 1, quote)
            if at is None:
                return None

    def lexer(text: str) -> str | None:
        out, depth, levels, begun, blank, mixed = [], 0, [(0, 0)], False, (0, 0), False
        if text[:1] == "\ufeff":
            text = text[1:]
        if "\0" in text:
            return None
        at, last = 0, len(text)
        while at < last:
            again = None
            for m in pattern.finditer(text, at):
                kind = m.lastgroup
                if kind == "w":
                    if not begun and text[m.start()] in " \t\f":
                        space = m[0].rpartition("\f")[2]
                        blank = len(space.expandtabs(8)), len(space)
                    continue
                if kind == "l":
                    if begun and not depth:
                        out.append(new_line)
                        begun = False
                    if not begun:
                        blank = (0, 0)
                    continue
                if kind == "e":
                    return None
                if not begun and not depth:
                    begun = True
                    if blank[0] > levels[-1][0]:
                        mixed = mixed or blank[1] <= levels[-1][1]
                        levels.append(blank)
                        if not out:
                            return None
                        out[-1] = "<"
                    else:
                        while blank[0] < levels[-1][0]:
                            levels.pop()
                            out.append(">")
                        if blank[0] != levels[-1][0]:
                            return None
                        mixed = mixed or blank[1] != levels[-1][1]
                if kind == "i":
                    out.append(words.get(m[0], identifier))
                elif kind == "o":
                    c = literal[m[0]]
                    if c in "([{":
                        depth += 1
                    elif c in ")]}":
                        depth -= 1
                        if depth < 0:
                            return None
                    out.append(c)
                elif kind == "f":
                    again = f_string(text, m)
                    if again is None:
                        return None
                    out.append(formatted)
                    break
                else:
                    c = quoted(m[0]) if kind == "s" else number(m[0]) if kind == "n" else ticks
                    if c is None:
                        return None
                    out.append(c)
            if again is None:
                break
            at = again
        if begun:
            out.append(new_line)
        out += ">" * (len(levels) - 1)
        return "".join([old, new_line, *out] if mixed else out)  # Python 3 wants one way of indenting

    follow = {char(w) for w in ("else", "elif", "except", "finally")}
    at_sign = char("@")
    fits = grammar._fits

    def segments(text: str) -> list[str]:
        out, at, last = [], 0, len(text)
        for i, c in enumerate(text):
            if (c == new_line and text[at] != at_sign or c >= "\U000f0000" and fits[c][0] == "<") and (i + 1 == last or text[i + 1] not in follow):
                out.append(text[at : i + 1])
                at = i + 1
        if at < last:
            out.append(text[at:])
        return out

    return Language(grammar, lexer, segments, grammar.all)


# Languages with braces

_C_STRING = r"\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*+\""
_C_CHAR = r"'(?:[^'\\\r\n]|\\(?:\r\n|.))++'"
_C_COMMENT = r"//[^\r\n]*|/\*(?:[^*]|\*(?!/))*+\*/"
_C_NUMBER = r"(?:0[xX][\da-fA-F_'.]+(?:[pP][+-]?\d+)?|0[bB][01_']+|(?:\d[\d_']*+(?:\.(?!\.)[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d[\d_]*+)?)\w*"


def _plain_lexer(grammar: Grammar, literal: dict[str, str], pattern: re.Pattern, kinds: dict[str, str], ends: frozenset | None = None):
    """A lexer that drops blanks and comments; with ``ends``, a line break behind one of these tokens is a ``;``."""
    chars = {k: grammar.alphabet.char(t) for k, t in kinds.items()} | {"i": grammar.alphabet.char("ID"), "z": "", "e": "\0", "l": ""}
    stop = grammar.alphabet.char(";")
    known = literal.get

    def lexer(text: str) -> str | None:
        if ends is None:
            out = [known(m[k := m.lastgroup]) or chars[k] for m in pattern.finditer(text)]
        else:
            out, before = [], ""
            for m in pattern.finditer(text):
                k = m.lastgroup
                s = m[k]
                c = known(s) or chars[k]
                if k == "l":
                    if before not in ends or "\n" not in s:
                        continue
                    c = stop
                out.append(c)
                before = c
        found = "".join(out)
        return None if "\0" in found else found

    return lexer


@functools.cache
def go_language() -> Language:
    operators = _words("+ / % ^ << >> &^ == != < <= > >= && || & - ")
    assign = _words("+= -= *= /= %= &= |= ^= <<= >>= &^=")
    grammar = Grammar(GO, ["go"], {"OPERATOR": operators, "ASSIGN": assign}, ["Cases", "Comms"])
    literal = _literals(grammar)
    char = grammar.alphabet.char
    pattern = _tokens(r"[ \t\f]+", rf"(?P<l>\r\n|\n|\r|{_C_COMMENT})|(?P<s>{_C_STRING}|`[^`]*`)|(?P<c>{_C_CHAR})|(?P<n>{_C_NUMBER})|(?P<i>[^\W\d]\w*)|(?P<o>{_operators(literal)})|(?P<e>.)")
    ends = frozenset({char(t) for t in ("ID", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "++", "--")} | set(")]}"))
    lexer = _plain_lexer(grammar, literal, pattern, {"s": "STR", "c": "CHAR", "n": "NUM"}, ends)
    return Language(grammar, lexer, _statement_segments(grammar, "", headers="for if switch select"), grammar.all)


@functools.cache
def java_language() -> Language:
    modifiers = _words("public private protected abstract native strictfp transient volatile")
    primitives = _words("int long short byte char boolean float double")
    soft = _words("record sealed permits non yield when module open")
    operators = _words("+ / % ^ << == != <= && || * | - &")
    assign = _words("+= -= *= /= %= &= |= ^= <<= ")
    grammar = Grammar(JAVA, ["java"], {"ID": soft, "OPERATOR": operators, "ASSIGN": assign, "PREFIX": _words("! ~ ++ --"), "MODIFIER": modifiers, "PRIMITIVE": primitives, "RESERVED": _words("goto const")})
    literal = _literals(grammar)
    # A sign is unary and binary: it has a character of its own.
    plus = grammar.alphabet.char("-")
    literal["+"] = plus
    pattern = _tokens(rf"\s+|{_C_COMMENT}", rf"(?P<s>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|{_C_STRING})|(?P<c>{_C_CHAR})|(?P<n>{_C_NUMBER})|(?P<i>[^\W\d][\w$]*|\$[\w$]*)|(?P<o>{_operators(literal)})|(?P<e>.)")
    lexer = _plain_lexer(grammar, literal, pattern, {"s": "STR", "c": "CHAR", "n": "NUM"})
    starters = "ID MODIFIER PRIMITIVE @ static final void class interface enum if for while return try switch throw break continue synchronized"
    return Language(grammar, lexer, _statement_segments(grammar, starters.replace(" while", "")), grammar.all)


@functools.cache
def c_languages() -> dict[str, Language]:
    builtins = _words("void char short int long float double signed unsigned _Bool bool _Complex __int128 wchar_t char8_t char16_t char32_t")
    specifiers = _words("register restrict __restrict __restrict__ _Noreturn __inline __inline__ __const _Atomic _Thread_local __thread auto")
    cpp_words = _words("namespace template using typename class friend virtual explicit operator new delete try catch throw mutable constexpr consteval constinit decltype noexcept override final concept requires co_return co_yield co_await this nullptr true false typeid thread_local import module export")
    soft_both = _words("final override import module concept requires generic")
    only_c = [w for w in cpp_words if w not in ("true", "false", "nullptr")]
    operators = _words("/ % ^ << == != <= <=> || | ")
    assign = _words("+= -= *= /= %= &= |= ^= <<=")
    common = {"OPERATOR": operators, "ASSIGN": assign, "BUILTIN": builtins, "SPECIFIER": specifiers, "ASM": _words("asm __asm__ __asm"), "ATTRIBUTE": _words("__attribute__ __declspec"), "ACCESS": _words("public private protected"), "CAST": _words("static_cast dynamic_cast const_cast reinterpret_cast")}
    grammar = Grammar(CFAMILY, ["c", "cpp"], {"ID": soft_both, **common, "RESERVED": ["#", "##", "@"]})
    char = grammar.alphabet.char
    cpp = _literals(grammar)
    cpp.update({"_Static_assert": char("static_assert"), "_Alignas": char("alignas"), "_Alignof": char("alignof"), "__typeof__": char("typeof"), "typeof_unqual": char("typeof"), "_Generic": char("generic")})
    cpp["auto"] = char("auto")
    c = {t: x for t, x in cpp.items() if t not in only_c and t not in common["ACCESS"] + common["CAST"]}
    c["auto"] = char("SPECIFIER")
    directive = re.compile(r"^[ \t]*(?:#|%:)(?:[^\r\n\\/]|\\\r?\n|\\.|/(?!\*)|/\*(?:[^*]|\*(?!/))*+\*/)*", re.M)

    directives = frozenset(_words("define undef include include_next import if ifdef ifndef elif elifdef elifndef else endif error warning pragma line ident sccs assert unassert embed region endregion"))

    def variants(text: str) -> list[str]:
        """Texts without directives, so that each branch of each conditional stands in one of them, but for that of ``#if 0``.

        In the n-th text, every conditional is replaced by its n-th branch, or by its last if it has fewer;
        conditionals of one form that stand in several places are thus taken alike. A wrong directive gives a text that is rejected.
        """
        if "#" not in text:
            return [text]
        blocks = [(m.start(), m.end()) for m in re.finditer(rf"/\*(?:[^*]|\*(?!/))*+\*/|//[^\r\n]*|R\"(\w*)\((?:.|\n)*?\)\1\"", text)] if "/*" in text or 'R"' in text else []
        starts = [a for a, _ in blocks]
        marks, begun, counts = [], [], []  # (start, end, conditionals around what follows, with the branch of each)
        for m in directive.finditer(text):
            k = bisect_right(starts, m.start()) - 1
            if k >= 0 and m.start() < blocks[k][1]:
                continue
            word = re.match(r"[ \t]*(?:#|%:)[ \t]*(\w*)[ \t]*(.*)", m[0])
            name = word[1] if word else ""
            if name and name not in directives and not name.isdigit():
                return ["\0"]
            if name in ("if", "ifdef", "ifndef"):
                begun.append((len(counts), -1 if word[2].strip() == "0" else 0))
                counts.append(begun[-1][1] + 1)
            elif name in ("else", "elif", "elifdef", "elifndef", "endif"):
                if not begun:
                    return ["\0"]
                if name == "endif":
                    begun.pop()
                else:
                    begun[-1] = begun[-1][0], begun[-1][1] + 1
                    counts[begun[-1][0]] += 1
            marks.append((m.start(), m.end(), tuple(begun)))
        if begun:
            return ["\0"]
        made = []
        for n in range(max([1, *counts])):
            out, at, shown = [], 0, True
            for start, end, around in marks:
                if shown:
                    out.append(text[at:start])
                at, shown = end, all(0 <= branch == min(n, counts[i] - 1) for i, branch in around)
            made.append("".join(out) + text[at:])
        return made

    made = {}
    for dialects, literal in (("c", c), ("cpp", cpp)):
        pattern = _tokens(
            rf"\s+|\\\r?\n|{_C_COMMENT}",
            rf"(?P<s>(?:(?:u8|u|U|L)?R\"(?P<raw>[^\s()\\]{{0,16}})\((?:.|\n)*?\)(?P=raw)\"|(?:u8|u|U|L)?{_C_STRING})(?:_\w+)?)|(?P<c>(?:u8|u|U|L)?{_C_CHAR})|(?P<n>{_C_NUMBER})|(?P<i>[^\W\d][\w$]*)|(?P<o>{_operators(literal)})|(?P<e>.)",
        )
        kinds = {"s": "STR", "c": "CHAR", "n": "NUM", "raw": "STR"}
        lexer = _plain_lexer(grammar, literal, pattern, kinds)
        starters = "BUILTIN static if for return switch goto break continue typedef inline" + (" namespace template ACCESS virtual explicit using" if dialects == "cpp" else "")
        made[dialects] = Language(grammar, lexer, _statement_segments(grammar, starters), grammar.dialects[dialects], variants)
    return made


@functools.cache
def rust_language() -> Language:
    operators = _words("/ % ^ << == <= += -= *= /= %= ^= &= |= <<= ")
    reserved = _words("$ ~ yield become do final override priv abstract macro virtual unsized typeof try")
    grammar = Grammar(RUST, ["rust"], {"ID": _words("union auto default raw box macro_rules"), "OPERATOR": operators, "RANGE": _words(".. ..= ..."), "RESERVED": reserved}, ["Arms"])
    char = grammar.alphabet.char
    literal = _literals(grammar)
    pattern = _tokens(
        r"\s+|//[^\r\n]*",
        rf"(?P<m>/\*)|(?P<a>#!\[)|(?P<s>(?:b|c)?r(?P<h>#*)\"(?:.|\n)*?\"(?P=h)|[bc]?\"(?:[^\"\\]|\\.)*+\")|(?P<c>b?'(?:[^'\\\r\n]|\\(?:x[\da-fA-F]{{2}}|u\{{[\da-fA-F_]+\}}|.))')|(?P<t>'(?:[^\W\d]\w*))|(?P<n>(?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|\d[\d_]*+(?:\.(?![.\w])|\.\d[\d_]*+)?(?:[eE][+-]?[\d_]+)?)\w*)|(?P<i>(?:r#)?[^\W\d]\w*)|(?P<o>{_operators(literal)})|(?P<e>.)",
    )
    words = {t: c for t, c in literal.items() if re.match(r"\w", t)}
    identifier, string, character, number, lifetime, inner = (char(t) for t in ("ID", "STR", "CHAR", "NUM", "LIFETIME", "INNER"))
    edge = re.compile(r"/\*|\*/")

    def lexer(text: str) -> str | None:
        out: list[str] = []
        at, last = 0, len(text)
        if text.startswith("#!") and not text.startswith("#!["):
            at = text.find("\n") if "\n" in text else last
        while at < last:
            for m in pattern.finditer(text, at):
                kind = m.lastgroup
                if kind == "i":
                    out.append(words.get(m[kind], identifier))
                elif kind == "o":
                    out.append(literal[m[kind]])
                elif kind == "s" or kind == "h":
                    out.append(string)
                elif kind == "n":
                    out.append(number)
                elif kind == "z":
                    continue
                elif kind == "c":
                    out.append(character)
                elif kind == "t":
                    out.append(lifetime)
                elif kind == "m":  # comments nest
                    depth, end = 1, None
                    for e in edge.finditer(text, m.end()):
                        depth += 1 if e[0] == "/*" else -1
                        if not depth:
                            end = e.end()
                            break
                    if end is None:
                        return None
                    at = end
                    break
                elif kind == "a":  # an inner attribute
                    depth, end = 1, m.end()
                    while depth and end < last:
                        depth += {"[": 1, "]": -1}.get(text[end], 0)
                        end += 1
                    if depth:
                        return None
                    out.append(inner)
                    at = end
                    break
                else:
                    return None
            else:
                break
        return "".join(out)

    starters = "fn pub struct enum impl trait mod use const static let if for loop match return # ID"
    return Language(grammar, lexer, _statement_segments(grammar, starters), grammar.all)


@functools.cache
def script_languages() -> dict[str, Language]:
    soft_js = _words("async get set of as from static accessor let yield await assert undefined")
    soft_ts = _words("type declare namespace module abstract readonly override keyof unique infer asserts is satisfies global out implements")
    access = _words("public private protected")
    keywords = _words("var const function class extends if else for while do return break continue throw try catch finally switch case default import export new typeof void in instanceof this super null true false debugger with delete enum interface implements")
    operators = _words("/ % ^ << == != === !== <= && || ?? ** ")
    assign = _words("+= -= *= /= %= &= |= ^= <<= **= &&= ||= ??=")
    classes = {"ID": [*soft_js, *soft_ts], "OPERATOR": operators, "ASSIGN": assign, "PREFIX": _words("~ ++ -- delete"), "ACCESS": access}
    grammar = Grammar(JAVASCRIPT, ["js", "ts"], {**classes, "WORD": [*keywords, *soft_js, *soft_ts, *access, "PREFIX", "ACCESS"]}, ["Cases"])
    char = grammar.alphabet.char
    literal = _literals(grammar)
    words = {t: c for t, c in literal.items() if re.match(r"[\w$]", t)}
    body = (
        rf"(?P<l>[\r\n\u2028\u2029]\s*|/\*(?:[^*]|\*(?!/))*+\*/|<!--[^\r\n]*)|(?P<s>{_C_STRING}|'(?:[^'\\\r\n]|\\(?:\r\n|.))*+')|(?P<n>(?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*+(?:\.[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d+)?)n?(?![\w$]))"
        rf"|(?P<p>\#[^\W\d][\w$]*)|(?P<d>@(?:[^\W\d][\w$]*(?:\.[\w$]+)*|(?=\()))|(?P<i>(?:[^\W\d]|\$)(?:\w|\$)*)|(?P<t>`)"
    )
    pattern = _tokens(r"[^\S\r\n\u2028\u2029]+|//[^\r\n\u2028\u2029]*|/\*[^*\r\n]*\*/", body + rf"|(?P<o>{_operators(literal)})|(?P<e>.)")
    regex = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[dgimsuvy]*(?![\w$])")
    identifier, string, number, template, regular, decorator, stop = (char(t) for t in ("ID", "STR", "NUM", "TEMPLATE", "REGEX", "DECORATOR", ";"))
    private, hashbang, divide = char("PRIVATE"), char("HASHBANG"), literal["/"]
    # Behind these, a slash divides and a line break may end a statement.
    values = frozenset({identifier, string, number, template, regular, private, *(char(w) for w in ("this", "super", "null", "true", "false", "undefined", "void", "++", "--")), *(char(w) for w in [*soft_js, *soft_ts]), char("ACCESS"), *")]}"})
    restricted = frozenset(char(w) for w in ("return", "break", "continue", "throw", "debugger"))
    prefix_words = frozenset(char(w) for w in ("typeof", "void", "new", "in", "instanceof", "case", "delete", "return", "else", "do", "delete") if w in grammar.alphabet.chars)
    # Tokens that go on with an expression or statement begun on the line before.
    going_on = frozenset({char("OPERATOR"), char("ASSIGN"), *(char(t) for t in (".", "?.", ",", ":", "?", "=", "<", ">", "&", "|", "*", "-", "+", "=>", ";", "in", "instanceof", "else", "catch", "finally", "extends", "implements", "as", "satisfies", "from")), template, *"(["})

    def scan(text: str, at: int, inside: bool, out: list[str]) -> int | None:
        """Tokens from ``at`` on; inside a template up to its closing brace. None if a token cannot be formed."""
        brackets: list[str] = []
        fresh, before, again = False, out[-1] if out else "", True
        while again:
            again = False
            for m in pattern.finditer(text, at):
                kind = m.lastgroup
                if kind == "i":
                    c = words.get(m[kind], identifier)
                    if c is not identifier and before in property_signs:
                        c = identifier
                    if not fresh:
                        out.append(c)
                        before = c
                        continue
                elif kind == "l":
                    fresh = fresh or "\n" in m[kind] or "\r" in m[kind]
                    continue
                elif kind == "o":
                    s = m[kind]
                    c = literal[s]
                    if not fresh and s in plain_signs:
                        out.append(c)
                        before = c
                        continue
                    if (s == "/" or s == "/=") and (before not in values or before in prefix_words):
                        r = regex.match(text, m.start(kind))
                        if r is None:
                            return None
                        at, c, again = r.end(), regular, True
                elif kind == "s":
                    c = string
                elif kind == "n":
                    c = number
                elif kind == "z":
                    break
                elif kind == "t":
                    end = skip_template(text, m.end())
                    if end is None:
                        return None
                    at, c, again = end, template, True
                elif kind == "p":
                    c = private
                elif kind == "d":
                    c = decorator
                else:
                    return None
                if fresh:
                    fresh = False
                    if before and (not brackets or brackets[-1] == "{") and (before in restricted or before in values and c not in going_on and c != "}" and not (c == "{" and before in opens_block)):
                        out.append(stop)
                ended = ""
                if c in "([{":
                    brackets.append("@" if before == decorator and c == "(" else c)
                elif c in ")]}":
                    if not brackets:
                        return m.end() if inside and c == "}" else None
                    ended = brackets.pop()
                out.append(c)
                before = decorator if ended == "@" else c  # no statement ends behind the arguments of a decorator
                if again:
                    break
        return None if inside else len(text)

    plain_signs = frozenset(literal) - frozenset(["/", "/=", *"()[]{}"])
    property_signs = frozenset({char("."), char("?.")})
    opens_block = frozenset({")", identifier})

    def skip_template(text: str, at: int) -> int | None:
        """End of a template; what it embeds is recognised as an expression."""
        while True:
            m = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+(`|\$\{)", re.S).match(text, at)
            if m is None:
                return None
            at = m.end()
            if m[1] == "`":
                return at
            embedded: list[str] = []
            end = scan(text, at, True, embedded)
            if end is None or not grammar.accepts("Expr", "".join(embedded), PAIRS, segments):
                return None
            at = end

    def lexer(text: str) -> str | None:
        out: list[str] = []
        at = 0
        if text[:1] == "﻿":
            at = 1
        if text.startswith("#!", at):
            at = text.find("\n", at) if "\n" in text else len(text)
        return "".join(out) if scan(text, at, False, out) is not None else None

    starters = "ID var const let function class if for return try switch throw export import async DECORATOR type declare interface abstract"
    segments = _statement_segments(grammar, starters)
    return {name: Language(grammar, lexer, segments, mask) for name, mask in (("js", grammar.dialects["js"]), ("ts", grammar.dialects["ts"]))}


def language(extension: str) -> Language | None:
    """The language of a file extension, or None if it is not supported."""
    if extension == "json":
        return json_language()
    if extension in ("py", "pyi"):
        return python_language()
    if extension in ("js", "mjs", "cjs"):
        return script_languages()["js"]
    if extension in ("ts", "mts", "cts"):
        return script_languages()["ts"]
    if extension == "go":
        return go_language()
    if extension == "java":
        return java_language()
    if extension == "rs":
        return rust_language()
    if extension == "c":
        return c_languages()["c"]
    if extension == "h":  # either language
        return c_languages()["c"]._replace(dialects=0b11, lexer=c_languages()["cpp"].lexer)
    if extension in ("cc", "cpp", "cxx", "hpp", "hh", "hxx"):
        return c_languages()["cpp"]
    return None

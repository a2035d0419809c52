"""Grammars of the supported languages. Operators are flat: only acceptance matters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial

from quarrylight.llm.syntax import lexers
from quarrylight.llm.syntax.gll import Grammar, Rules, read_rules, together

JSON = """
file: value ;
value: '{' (pair (',' pair)*)? '}' | '[' (value (',' value)*)? ']' | STR | NUM | 'true' | 'false' | 'null' ;
pair: STR ':' value ;
"""

TOML = """
file: line* ;
line: NL | '[' key ']' NL | '[' '[' key ']' ']' NL | key '=' value NL ;
key: part ('.' part)* ;
part: BARE | STR | NUM | BOOL ;
value: STR | MLSTR | NUM | BOOL | '[' NL* (value NL* (',' NL* value NL*)* (',' NL*)?)? ']' | '{' (pair (',' pair)*)? '}' ;
pair: key '=' value ;
"""

YAML = """
file: DOC* (node DOC+)* node? ;
node: block | NL ;
block: IND lines DED ;
lines: mapping+ | sequence+ | texts | value NL texts? ;
texts: STR NL (STR NL | IND texts DED)* ;
mapping: name ':' rest | '?' IND lines DED (':' rest)? ;
name: PROP* STR | PROP* flow ;
rest: PROP* NL (block | sequence+)? | PROP* value NL (IND texts DED)? ;
sequence: '-' (NL block? | IND inner DED) ;
inner: mapping+ | sequence+ | PROP* value NL (IND? texts DED?)? | PROP+ NL (lines | block)? | PROP+ mapping+ ;
value: STR | flow ;
flow: '[' (entry@)? ']' | '{' (entry@)? '}' ;
entry: PROP* item (':' (PROP* item)?)? | ':' item ;
item: STR | flow ;
"""

PYTHON = """
file: (NEWLINE | statement)* ;
suite_block: INDENT (statement | NEWLINE)+ DEDENT ;
arms: INDENT arm+ DEDENT ;
statement: line | compound ;
line: small (';' small)* ';'? NEWLINE ;
small: expression_statement | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (test ('from' test)?)? | 'del' targets
  | ('global' | 'nonlocal') id (',' id)* | 'import' dotted_as (',' dotted_as)* | 'from' ('.' | '...')* dotted? 'import' ('*' | names | '(' names ','? ')')
  | 'assert' test (',' test)? | 'type' id typed? '=' test ;
dotted: id ('.' id)* ;
dotted_as: dotted ('as' id)? ;
names: id ('as' id)? (',' id ('as' id)?)* ;
expression_statement: produced | (targets '=')+ produced | target ':' test ('=' produced)? | target augmented produced ;
augmented: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' | '@=' ;
produced: stars | yielded ;
yielded: 'yield' ('from' test | stars)? ;
compound: 'if' named ':' suite ('elif' named ':' suite)* otherwise? | 'while' named ':' suite otherwise? | 'async'? 'for' targets 'in' stars ':' suite otherwise?
  | 'try' ':' suite (handler+ otherwise? last? | last) | 'async'? 'with' items ':' suite | decorator* (function | klass) | 'match' stars ':' NEWLINE arms ;
otherwise: 'else' ':' suite ;
last: 'finally' ':' suite ;
handler: 'except' '*'? (stars ('as' id)?)? ':' suite ;
items: item (',' item)* | '(' item@ ')' ;
item: test ('as' target)? ;
arm: 'case' stars ('as' id)? ('if' named)? ':' suite ;
decorator: '@' named NEWLINE ;
function: 'async'? 'def' id typed? '(' parameters? ')' ('->' test)? ':' suite ;
klass: 'class' id typed? ('(' arguments? ')')? ':' suite ;
typed: '[' type_parameter@ ']' ;
type_parameter: ('*' | '**')? id (':' test)? ('=' star)? ;
parameters: bare more_bare? | optional more_optional? | starred ;
more_bare: ',' (parameters | '/' (',' after_slash?)?)? ;
after_slash: parameters ;
more_optional: ',' (optional more_optional? | starred | '/' (',' (optional more_optional? | starred)?)?)? ;
starred: '*' id (':' star)? (',' keyword_only?)? | '*' ',' keyword_only | '**' bare ','? ;
keyword_only: (bare | optional) (',' keyword_only?)? | '**' bare ','? ;
bare: id (':' test)? ;
optional: bare '=' test ;
suite: line | NEWLINE suite_block ;
targets: target@ ;
target: '*'? (id | '(' targets? ')' | '[' targets? ']' | atom trailer* ('.' id | '[' slices ']') | 'await' atom trailer* ('.' id | '[' slices ']')) ;
stars: star@ ;
star: '*' operand (binary operand)* | named ;
named: test | id ':=' test ;
test: lambda | operand (binary operand)* ('if' operand (binary operand)* 'else' test)? ;
lambda: 'lambda' lambda_parameters? ':' test ;
lambda_parameters: id lambda_bare? | id '=' test lambda_optional? | lambda_starred ;
lambda_bare: ',' (lambda_parameters | '/' (',' lambda_parameters?)?)? ;
lambda_optional: ',' (id '=' test lambda_optional? | lambda_starred | '/' (',' (id '=' test lambda_optional? | lambda_starred)?)?)? ;
lambda_starred: '*' id (',' lambda_only?)? | '*' ',' lambda_only | '**' id ','? ;
lambda_only: id ('=' test)? (',' lambda_only?)? | '**' id ','? ;
binary: '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '&' | '|' | '^' | '<<' | '>>' | '<' | '>' | '==' | '!=' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | 'and' | 'or' ;
operand: ('-' | '+' | '~' | 'not' | 'await')* primary ;
primary: atom trailer* ;
trailer: '.' id | '(' arguments? ')' | '[' slices ']' ;
slices: slice@ ;
slice: star | test? ':' test? (':' test?)? ;
arguments: argument@ ;
argument: named comprehension? | id '=' test | '*' test | '**' test ;
comprehension: 'async'? 'for' targets 'in' operand (binary operand)* ('if' named)* comprehension? ;
atom: id | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' (yielded | star comprehension | stars)? ')' | '[' (star comprehension | stars)? ']'
  | '{' (pair comprehension | pair@ | star comprehension | stars)? '}' ;
pair: test ':' test | '**' operand (binary operand)* ;
id: ID | 'match' | 'case' | 'type' | '_' ;
"""

#: Rules that differ in Python 2, which is not among the default dialects.
PYTHON_2 = """
small: expression_statement | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (test (',' test (',' test)?)?)? | 'del' targets
  | 'global' id (',' id)* | 'import' dotted_as (',' dotted_as)* | 'from' '.'* dotted? 'import' ('*' | names | '(' names ','? ')')
  | 'assert' test (',' test)? | 'print' (stars | '>>' test (',' stars)?)? | 'exec' operand (binary operand)* ('in' test (',' test)?)? ;
handler: 'except' (test (('as' | ',') target)?)? ':' suite ;
id: ID | 'match' | 'case' | 'type' | '_' | 'async' | 'await' | 'nonlocal' ;
"""

SCRIPT = """
file: item* ;
item: statement | 'import' imports | 'export' exports ;
imports: STR with? EOS | 'type'? import_names 'from' STR with? EOS | ident '=' expr EOS ;
with: 'with' object ;
import_names: ident | ident ',' import_set | import_set ;
import_set: '*' 'as' ident | '{' specifier@? '}' ;
specifier: 'type'? (name | STR) ('as' (name | STR))? ;
exports: 'default' (function | class | assign EOS | 'abstract' class %(default)s) | '*' ('as' (name | STR))? 'from' STR EOS | 'type'? '{' specifier@? '}' ('from' STR with?)? EOS
  | declaration | '=' expr EOS | 'as' 'namespace' ident EOS ;
declaration: variables EOS | named_function | named_class %(declarations)s ;
statement: block | variables EOS | named_function | named_class %(declarations)s | 'if' '(' expr ')' statement ('else' statement)? | 'for' 'await'? '(' for_head ')' statement
  | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' EOS | 'return' expr? EOS | 'throw' expr EOS | ('break' | 'continue') ident? EOS | 'debugger' EOS
  | 'try' block ('catch' ('(' pattern annotation ')')? block)? ('finally' block)? | 'switch' '(' expr ')' '{' clause* '}' | ';' | ident ':' statement | 'with' '(' expr ')' statement | first EOS ;
clause: ('case' expr | 'default') ':' statement* ;
block: '{' statement* '}' ;
for_head: (variables | expr)? ';' expr? ';' expr? | ('var' | 'let' | 'const') pattern annotation ('of' assign | 'in' expr) | operand ('of' assign | 'in' expr) ;
variables: ('var' | 'let' | 'const') variable (',' variable)* ;
variable: pattern %(definite)s annotation ('=' assign)? ;
pattern: ident | '[' gaps ']' | '{' (bound@)? '}' ;
element: '...'? pattern ('=' assign)? ;
bound: '...' pattern | ident ('=' assign)? | property ':' pattern ('=' assign)? ;
named_function: 'async'? 'function' '*'? ident type_parameters parameters return_type %(body)s ;
function: 'async'? 'function' '*'? ident? type_parameters parameters return_type %(body)s ;
parameters: '(' (parameter@)? ')' ;
parameter: %(modifiers)s '...'? pattern %(optional)s annotation ('=' assign)? %(this)s ;
named_class: decorator* %(abstract)s 'class' ident type_parameters heritage '{' member* '}' ;
class: decorator* %(abstract)s 'class' ident? type_parameters heritage '{' member* '}' ;
decorator: '@' ident ('.' name)* ('(' arguments? ')')? ;
member: ';' | decorator* member_words property_mark type_parameters parameters return_type %(method_body)s | decorator* member_words property %(mark)s annotation ('=' assign)? EOS | 'static' block %(index_member)s ;
member_words: ('static' | 'async' | 'get' | 'set' | 'accessor' %(member_word)s)* ;
property_mark: '*'? property %(optional)s ;
property: name | STR | NUM | '[' assign ']' | '#' name ;
first: (first_operand | prefix+ operand | arrow | 'async' arrow) tail* (',' assign)* ;
first_operand: plain postfix* ;
expr: assign (',' assign)* ;
assign: (arrow | 'yield' '*'? assign? | operand) tail* ;
tail: binary operand | '?' assign ':' assign | assigning assign %(casts)s ;
assigning: '=' | '+=' | '-=' | '*=' | '/=' | '%%=' | '**=' | '<<=' | '>' '>=' | '>' '>' '>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' ;
binary: '+' | '-' | '*' | '/' | '%%' | '**' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&&' | '||' | '??' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | 'in' | 'instanceof' ;
arrow: 'async'? (ident | type_parameters parameters return_type) '=>' (arrow_block | assign) ;
arrow_block: '{' statement* '}' ;
prefix: '!' | '-' | '+' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' ;
operand: prefix* primary postfix* ;
postfix: '.' '#'? name | '?.' (name | '[' expr ']' | '(' arguments? ')') | '[' expr ']' | '(' arguments? ')' | template | '++' | '--' %(postfixes)s ;
arguments: argument@ ;
argument: '...'? assign ;
primary: plain | object | function | class ;
plain: ident | NUM | STR | REGEX | template | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | '[' holes ']'
  | 'new' primary | 'new' '.' name | 'import' ('(' arguments ')' | '.' name) | '#' name ;
holes: ',' holes | argument after_hole | ;
after_hole: ',' holes | ;
gaps: ',' gaps | element after_gap | ;
after_gap: ',' gaps | ;
template: '`start' ('${' expr '}$')* '`end' ;
object: '{' (entry@)? '}' ;
entry: '...' assign | ident ('=' assign)? | property ':' assign | ('async' | 'get' | 'set')* '*'? property type_parameters parameters return_type block ;
ident: ID | %(soft)s ;
name: ID | %(words)s ;
"""

_JS_PARTS = {
    "declarations": "", "definite": "", "body": "block", "modifiers": "", "optional": "", "abstract": "", "method_body": "block", "mark": "",
    "index_member": "", "member_word": "", "casts": "", "postfixes": "", "this": "", "default": "",
}
_JS_RULES = """
annotation: ;
return_type: ;
type_parameters: ;
heritage: ('extends' operand)? ;
"""
_TS_PARTS = {
    "declarations": "| interface | alias | enum | namespace | 'declare' item_declared",
    "definite": "'!'?",
    "body": "(block | EOS)",
    "modifiers": "decorator* ('public' | 'private' | 'protected' | 'readonly' | 'override')*",
    "optional": "'?'?",
    "abstract": "('abstract' | 'declare')*",
    "method_body": "(block | EOS)",
    "mark": "('?' | '!')?",
    "index_member": "| member_words '[' ident ':' type ']' annotation EOS",
    "member_word": "| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'",
    "casts": "| ('as' | 'satisfies') type",
    "this": "| 'this' ':' type",
    "default": "| interface",
    "postfixes": "| '!' | type_arguments '(' arguments? ')'",
}
_TS_RULES = """
annotation: (':' type)? ;
return_type: (':' type)? ;
type_parameters: ('<' type_parameter@ '>')? ;
type_parameter: 'const'? 'in'? name ('extends' type)? ('=' type)? ;
heritage: ('extends' operand type_arguments?)? ('implements' type (',' type)*)? ;
interface: 'interface' ident type_parameters ('extends' type (',' type)*)? object_type ;
alias: 'type' ident type_parameters '=' type EOS ;
enum: 'const'? 'enum' ident '{' (enumerator@)? '}' ;
enumerator: property ('=' assign)? ;
namespace: ('namespace' | 'module') (ident ('.' ident)* | STR) '{' item* '}' | 'global' '{' item* '}' ;
item_declared: declaration | 'module' STR EOS ;
type_arguments: '<' type (',' type)* '>' ;
type: union ('extends' union '?' type ':' type)? | function_type | ident 'is' type | 'asserts' (ident | 'this') ('is' type)? | 'this' 'is' type ;
union: ('|' | '&')? single (('|' | '&') single)* ;
single: ('keyof' | 'unique' | 'readonly' | 'infer')* base ('[' type? ']')* ;
base: name ('.' name)* type_arguments? | STR | NUM | '-' NUM | template_type | object_type | '[' (tuple_item@)? ']' | '(' type ')' | 'typeof' name ('.' name)* type_arguments? | 'import' '(' STR ')' ('.' name)* type_arguments? ;
template_type: '`start' ('${' type '}$')* '`end' ;
tuple_item: '...'? (name '?'? ':')? type '?'? ;
function_type: 'abstract'? 'new'? type_parameters parameters '=>' type ;
object_type: '{' (type_member (member_end type_member)* member_end?)? '}' ;
member_end: ',' | EOS ;
type_member: ('readonly' | '+' | '-' | 'get' | 'set')* (property '?'? annotation | property '?'? type_parameters parameters return_type | '[' name ':' type ']' annotation | '[' name 'in' type ('as' type)? ']' ('-' | '+')? '?'? annotation) | 'new'? type_parameters parameters return_type ;
"""


JAVA = """
file: (annotation* 'package' dotted ';')? import* (typed | ';')* ;
import: 'import' 'static'? dotted ('.' '*')? ';' ;
dotted: id ('.' id)* ;
typed: modifier* (class | interface | enum | record | annotated) ;
modifier: annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' ;
annotation: '@' dotted ('(' (pairs | element)? ')')? ;
pairs: id '=' element (',' id '=' element)* ;
element: expr | annotation | '{' (element@)? '}' ;
class: 'class' id generics? ('extends' type)? ('implements' types)? ('permits' types)? body ;
interface: 'interface' id generics? ('extends' types)? ('permits' types)? body ;
enum: 'enum' id ('implements' types)? '{' (constant@)? (';' member*)? '}' ;
constant: annotation* id ('(' arguments? ')')? body? ;
record: 'record' id generics? '(' parameters? ')' ('implements' types)? body ;
annotated: '@' 'interface' id body ;
body: '{' member* '}' ;
member: ';' | typed | modifier* generics? (type | 'void') id '(' parameters? ')' dims throws? (block | 'default' element ';' | ';') | modifier* generics? id '(' parameters? ')' throws? block
  | modifier* type variable (',' variable)* ';' | 'static'? block | modifier* id block ;
throws: 'throws' types ;
generics: '<' generic (',' generic)* '>' ;
generic: annotation* id ('extends' type ('&' type)*)? ;
types: type (',' type)* ;
type: annotation* (primitive | named) dims ;
named: id targs? ('.' annotation* id targs?)* ;
targs: '<' (targ (',' targ)*)? '>' ;
targ: type | annotation* '?' (('extends' | 'super') type)? ;
dims: (annotation* '[' ']')* ;
primitive: 'boolean' | 'byte' | 'char' | 'double' | 'float' | 'int' | 'long' | 'short' ;
parameters: parameter (',' parameter)* ;
parameter: ('final' | annotation)* type '...'? (id | 'this') dims ;
variable: id dims ('=' (expr | array))? ;
array: '{' ((expr | array) (',' (expr | array))* ','?)? '}' ;
block: '{' statement* '}' ;
local: ('final' | annotation)* (type | 'var') variable (',' variable)* ;
statement: block | ';' | local ';' | typed | expr ';' | 'if' '(' expr ')' statement ('else' statement)? | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';'
  | 'for' '(' (local | expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)? ')' statement | 'for' '(' ('final' | annotation)* (type | 'var') id dims ':' expr ')' statement
  | 'return' expr? ';' | 'throw' expr ';' | ('break' | 'continue') id? ';' | 'yield' expr ';' | 'assert' expr (':' expr)? ';' | 'synchronized' '(' expr ')' block
  | 'try' resources? block catch* ('finally' block)? | switch | id ':' statement ;
resources: '(' resource (';' resource)* ';'? ')' ;
resource: local | expr ;
catch: 'catch' '(' ('final' | annotation)* type ('|' type)* id ')' block ;
switch: 'switch' '(' expr ')' '{' (label ':' statement* | label '->' (expr ';' | block | 'throw' expr ';'))* '}' ;
label: 'case' case_item (',' case_item)* ('when' expr)? | 'default' ;
case_item: expr | 'default' | type id | named '(' (parameter (',' parameter)*)? ')' id? ;
expr: operand tail* ;
tail: binary operand | '?' expr ':' expr | assigning expr | 'instanceof' 'final'? (type id? | named '(' (parameter (',' parameter)*)? ')') ;
assigning: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' ;
binary: '+' | '-' | '*' | '/' | '%' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' ;
operand: lambda | ('+' | '-' | '!' | '~' | '++' | '--')* (cast | primary postfix*) ;
cast: '(' type ('&' type)* ')' operand ;
lambda: (id | '(' (lambda_parameters | parameters)? ')') '->' (expr | block) ;
lambda_parameters: ('var'? id) (',' 'var'? id)* ;
postfix: '.' (targs? id | 'class' | 'this' | 'super' | new) | '[' expr ']' | '(' arguments? ')' | '++' | '--' | '::' targs? (id | 'new') ;
arguments: expr (',' expr)* ;
primary: id | NUM | STR | 'true' | 'false' | 'null' | 'this' | 'super' | '(' expr ')' | new | primitive dims ('.' 'class' | '::' 'new') | 'void' '.' 'class' | switch | named ('[' ']')+ ('.' 'class' | '::' 'new') | named '::' (id | 'new') ;
new: 'new' annotation* (primitive | named) ('(' arguments? ')' body? | ('[' expr ']')+ dims | ('[' ']')+ array) ;
id: ID | 'var' | 'record' | 'yield' | 'sealed' | 'permits' | 'when' | 'non' | 'open' | 'module' | 'requires' | 'transitive' | 'exports' | 'opens' | 'to' | 'uses' | 'provides' | 'with' ;
"""

SQL = """
file: (statement? ';')* statement? ;
statement: query | insert | update | delete | merge | create | alter | drop | truncate | grant | transaction | explain | session | maintenance ;
query: with? body (('UNION' | 'INTERSECT' | 'EXCEPT') ('ALL' | 'DISTINCT')? body)* order? limits* locking* ;
with: 'WITH' 'RECURSIVE'? cte (',' cte)* ;
cte: id columns? 'AS' ('NOT'? 'MATERIALIZED')? '(' (query | insert | update | delete) ')' ;
body: select | '(' query ')' | 'VALUES' row (',' row)* | 'TABLE' path ;
select: 'SELECT' quantity output (',' output)* ('INTO' path)? ('FROM' source (',' source)*)? ('WHERE' expr)? ('GROUP' 'BY' (list | 'ALL'))? ('HAVING' expr)? ('QUALIFY' expr)? ('WINDOW' named_window (',' named_window)*)? ;
quantity: ('ALL' | 'DISTINCT' ('ON' '(' list ')')?)? ;
named_window: id 'AS' '(' window ')' ;
output: expr ('AS'? alias)? | path '.' '*' | '*' ;
alias: id | STR ;
source: table join* ;
table: 'LATERAL'? (path call? | '(' query ')' | '(' source ')' | 'VALUES' row (',' row)* | '(' 'VALUES' row (',' row)* ')') ('AS'? id columns?)? sample? ;
sample: 'TABLESAMPLE' id '(' expr ')' ;
join: 'NATURAL'? ('INNER' | ('LEFT' | 'RIGHT' | 'FULL') ('OUTER' | 'SEMI' | 'ANTI')? | 'CROSS' | 'ASOF')? 'JOIN' table ('ON' expr | 'USING' columns)? ;
columns: '(' id (',' id)* ')' ;
order: 'ORDER' 'BY' (ordering (',' ordering)* | 'ALL') ;
ordering: expr ('ASC' | 'DESC')? ('NULLS' ('FIRST' | 'LAST'))? ;
limits: 'LIMIT' (expr | 'ALL') | 'OFFSET' expr ('ROW' | 'ROWS')? | 'FETCH' ('FIRST' | 'NEXT') expr? ('ROW' | 'ROWS') ('ONLY' | 'WITH' 'TIES') ;
locking: 'FOR' ('NO' 'KEY')? ('UPDATE' | 'KEY'? 'SHARE') ('OF' path (',' path)*)? ('NOWAIT' | 'SKIP' 'LOCKED')? ;
insert: with? 'INSERT' insert_mode 'INTO' 'TABLE'? path ('AS' id)? columns? (query | 'DEFAULT' 'VALUES') conflict? returning? ;
insert_mode: ;
conflict: 'ON' 'CONFLICT' ('(' key_part (',' key_part)* ')' ('WHERE' expr)? | 'ON' 'CONSTRAINT' id)? 'DO' ('NOTHING' | 'UPDATE' 'SET' settings ('WHERE' expr)?) ;
returning: 'RETURNING' output (',' output)* ;
update: with? 'UPDATE' 'ONLY'? path ('AS'? id)? 'SET' settings ('FROM' source (',' source)*)? ('WHERE' expr)? update_end returning? ;
update_end: ;
settings: setting (',' setting)* ;
setting: path '=' (expr | 'DEFAULT') | '(' path (',' path)* ')' '=' expr ;
delete: with? 'DELETE' 'FROM' 'ONLY'? path ('AS'? id)? ('USING' source (',' source)*)? ('WHERE' expr)? update_end returning? ;
merge: with? 'MERGE' 'INTO'? path ('AS'? id)? 'USING' table 'ON' expr merge_when+ ;
merge_when: 'WHEN' 'NOT'? 'MATCHED' ('BY' id)? ('AND' expr)? 'THEN' ('UPDATE' 'SET' ('*' | settings) | 'DELETE' | 'INSERT' ('*' | columns? 'VALUES' row) | 'DO' 'NOTHING') ;
create: 'CREATE' or_replace? created ;
or_replace: 'OR' 'REPLACE' ;
absent: 'IF' 'NOT' 'EXISTS' ;
present: 'IF' 'EXISTS' ;
behaviour: 'CASCADE' | 'RESTRICT' ;
created: scope* 'TABLE' absent? path table_body | ('MATERIALIZED' | scope | 'RECURSIVE')* 'VIEW' absent? path columns? table_option* 'AS' query view_end?
  | 'UNIQUE'? 'INDEX' 'CONCURRENTLY'? absent? path? 'ON' 'ONLY'? path ('USING' id)? '(' key_part (',' key_part)* ')' index_option*
  | 'SCHEMA' absent? path ('AUTHORIZATION' id)? | 'DATABASE' absent? path database_option* | 'TEMPORARY'? 'SEQUENCE' absent? path sequence_option*
  | 'TYPE' path ('AS' ('ENUM' '(' (STR (',' STR)*)? ')' | '(' attribute (',' attribute)* ')'))? | 'DOMAIN' path 'AS'? type constraint*
  | 'EXTENSION' absent? (id | STR) ('WITH' | 'SCHEMA' id | 'VERSION' (STR | id) | 'CASCADE')*
  | ('FUNCTION' | 'PROCEDURE') absent? path '(' (argument_of (',' argument_of)*)? ')' ('RETURNS' returned)? routine_option* routine_body?
  | 'TRIGGER' absent? path ('BEFORE' | 'AFTER' | 'INSTEAD' 'OF')? event ('OR' event)* 'ON' path ('FOR' 'EACH'? ('ROW' | 'STATEMENT'))? ('WHEN' '(' expr ')')? ('EXECUTE' ('FUNCTION' | 'PROCEDURE') path call | routine_body)
  | ('ROLE' | 'USER') absent? account role_option* | 'POLICY' id 'ON' path ('FOR' policy_of)? ('TO' accounts)? ('USING' '(' expr ')')? ('WITH' 'CHECK' '(' expr ')')? ;
policy_of: 'ALL' | 'SELECT' | 'INSERT' | 'UPDATE' | 'DELETE' ;
scope: 'TEMP' | 'TEMPORARY' | 'UNLOGGED' | 'EXTERNAL' | 'GLOBAL' | 'LOCAL' | 'TRANSIENT' ;
view_end: 'WITH' ('CASCADED' | 'LOCAL')? 'CHECK' 'OPTION' | 'WITH' 'NO'? 'DATA' ;
table_body: '(' element (',' element)* ')' table_option* ('AS'? query)? | columns? table_option* 'AS' query view_end? | 'LIKE' path | '(' 'LIKE' path like_option* ')'
  | 'PARTITION' 'OF' path ('DEFAULT' | 'FOR' 'VALUES' ('IN' '(' list ')' | 'FROM' '(' list ')' 'TO' '(' list ')' | 'WITH' '(' option_list ')')) ;
like_option: ('INCLUDING' | 'EXCLUDING') (id | 'ALL') ;
element: column | table_constraint | 'LIKE' path like_option* ;
column: id type? constraint* ;
attribute: id type ;
constraint: ('CONSTRAINT' id)? ('NOT'? 'NULL' | 'DEFAULT' initial | 'PRIMARY' 'KEY' ('ASC' | 'DESC')? | 'UNIQUE' | 'CHECK' '(' expr ')' | 'REFERENCES' path columns? reference* | 'COLLATE' path
  | 'GENERATED' ('ALWAYS' | 'BY' 'DEFAULT') 'AS' ('IDENTITY' ('(' sequence_option* ')')? | '(' expr ')' stored?) | 'AS' '(' expr ')' stored? | 'COMMENT' STR | constraint_more) ;
constraint_more: 'NOT'? 'DEFERRABLE' | 'INITIALLY' id ;
stored: 'STORED' | 'VIRTUAL' ;
initial: ('-' | '+')? primary ('::' type)* ;
table_constraint: ('CONSTRAINT' id)? ('PRIMARY' 'KEY' key_parts | 'UNIQUE' ('NULLS' 'NOT'? 'DISTINCT')? key_parts | 'FOREIGN' 'KEY' columns 'REFERENCES' path columns? reference* | 'CHECK' '(' expr ')' | table_constraint_more) constraint_more* ;
table_constraint_more: 'EXCLUDE' ('USING' id)? '(' exclusion (',' exclusion)* ')' ;
exclusion: expr 'WITH' (binary | '&' '&') ;
key_parts: '(' key_part (',' key_part)* ')' ;
key_part: expr path? ('ASC' | 'DESC')? ('NULLS' ('FIRST' | 'LAST'))? ;
reference: 'ON' ('DELETE' | 'UPDATE') ('CASCADE' | 'RESTRICT' | 'SET' ('NULL' | 'DEFAULT') | 'NO' 'ACTION') | 'MATCH' id | constraint_more ;
table_option: 'WITH' '(' option_list ')' | 'TABLESPACE' id | 'ON' 'COMMIT' ('DROP' | 'DELETE' 'ROWS' | 'PRESERVE' 'ROWS') | 'PARTITION' 'BY' id? '(' list ')' | 'PARTITIONED' 'BY' '(' (column (',' column)*) ')'
  | 'CLUSTERED' 'BY' columns ('INTO' NUM 'BUCKETS')? | 'CLUSTER' 'BY' (columns | list) | 'USING' id | 'INHERITS' '(' path (',' path)* ')' | 'STORED' 'AS' id | 'LOCATION' STR | ('OPTIONS' | 'TBLPROPERTIES') '(' option_list ')' | 'COMMENT' '='? STR | table_option_more ;
table_option_more: 'ROW' 'FORMAT' id ('FIELDS' 'TERMINATED' 'BY' STR)? ;
option_list: option (',' option)* ;
option: (path | STR) ('='? (expr | 'ON' | 'DEFAULT'))? ;
index_option: 'INCLUDE' columns | 'WITH' '(' option_list ')' | 'TABLESPACE' id | 'WHERE' expr | 'NULLS' 'NOT'? 'DISTINCT' ;
database_option: 'WITH' | 'DEFAULT' | ('OWNER' | 'ENCODING' | 'TEMPLATE' | 'COLLATE' | 'TABLESPACE' | 'LOCALE') '='? (id | STR | 'DEFAULT') | 'CHARACTER' 'SET' '='? (id | STR) | 'CONNECTION' 'LIMIT' '='? NUM ;
sequence_option: 'AS' type | 'START' 'WITH'? signed | 'INCREMENT' 'BY'? signed | ('MINVALUE' | 'MAXVALUE' | 'CACHE') signed | 'NO' ('MINVALUE' | 'MAXVALUE' | 'CYCLE' | 'CACHE') | 'CYCLE' | 'OWNED' 'BY' path | 'RESTART' ('WITH'? signed)? ;
signed: '-'? NUM ;
argument_of: ('IN' | 'OUT' | 'INOUT' | 'VARIADIC')? path? type (('DEFAULT' | '=') expr)? ;
returned: 'TABLE' '(' attribute (',' attribute)* ')' | 'SETOF'? type ;
routine_option: 'LANGUAGE' (id | STR) | 'AS' STR (',' STR)? | 'IMMUTABLE' | 'STABLE' | 'VOLATILE' | 'STRICT' | 'DETERMINISTIC' | 'NOT' 'DETERMINISTIC' | 'CALLED' 'ON' 'NULL' 'INPUT' | 'RETURNS' 'NULL' 'ON' 'NULL' 'INPUT' | 'SECURITY' id | ('PARALLEL' | 'COST' | 'ROWS') (id | NUM)
  | 'READS' 'SQL' 'DATA' | 'MODIFIES' 'SQL' 'DATA' | 'CONTAINS' 'SQL' | 'NO' 'SQL' | 'COMMENT' STR | 'SET' path ('=' | 'TO') (expr | 'DEFAULT') ;
routine_body: 'RETURN' expr | block ;
block: 'BEGIN' 'ATOMIC'? (step ';')* 'END' ;
step: statement | 'RETURN' expr? | 'DECLARE' id (',' id)* type ('DEFAULT' expr)? | 'IF' expr 'THEN' (step ';')* (('ELSEIF' | 'ELSIF') expr 'THEN' (step ';')*)* ('ELSE' (step ';')*)? 'END' 'IF' | 'WHILE' expr 'DO' (step ';')* 'END' 'WHILE' | 'LOOP' (step ';')* 'END' 'LOOP' | block ;
event: 'INSERT' | 'DELETE' | 'TRUNCATE' | 'UPDATE' ('OF' id (',' id)*)? ;
role_option: 'WITH' | 'PASSWORD' (STR | 'NULL') | 'IDENTIFIED' 'BY' STR | 'IN' ('ROLE' | 'GROUP') accounts | 'CONNECTION' 'LIMIT' signed | 'VALID' 'UNTIL' STR | 'LOGIN' | 'NOLOGIN' | 'SUPERUSER' | 'NOSUPERUSER' | 'CREATEDB' | 'NOCREATEDB' | 'CREATEROLE' | 'NOCREATEROLE' | 'INHERIT' | 'NOINHERIT' | 'REPLICATION' | 'NOREPLICATION' | 'BYPASSRLS' ;
account: (id | STR) PARAM? | PARAM ;
accounts: account (',' account)* ;
alter: 'ALTER' ('TABLE' present? 'ONLY'? path '*'? alteration (',' alteration)* | ('MATERIALIZED'? 'VIEW' | 'INDEX' | 'SEQUENCE' | 'SCHEMA' | 'DATABASE' | 'TYPE' | 'DOMAIN' | 'EXTENSION' | 'POLICY' | ('FUNCTION' | 'PROCEDURE')) present? path call? ('ON' path)? changed
  | ('ROLE' | 'USER') present? account ('RENAME' 'TO' id | 'SET' path ('=' | 'TO') (expr | 'DEFAULT') | role_option+) | 'SYSTEM' 'SET' path ('=' | 'TO') expr | 'DEFAULT' 'PRIVILEGES' ('IN' 'SCHEMA' id | 'FOR' ('ROLE' | 'USER') id)* grant) ;
changed: 'RENAME' ('TO' path | 'VALUE' STR 'TO' STR | 'COLUMN'? id 'TO' id | 'ATTRIBUTE' id 'TO' id) | 'OWNER' 'TO' account | 'SET' ('SCHEMA' id | 'TABLESPACE' id | '(' option_list ')' | path ('=' | 'TO') (expr | 'DEFAULT') | 'DEFAULT' expr | 'NOT' 'NULL') | 'DROP' ('DEFAULT' | 'NOT' 'NULL' | 'CONSTRAINT' present? id behaviour?)
  | 'ADD' ('VALUE' absent? STR (('BEFORE' | 'AFTER') STR)? | table_constraint | 'ATTRIBUTE' attribute) | 'AS' query | sequence_option+ | 'UPDATE' ('TO' (STR | id))? | database_option+ | 'TO' accounts ;
alteration: 'ADD' 'COLUMN'? absent? column placing? | 'ADD' 'COLUMN'? '(' column (',' column)* ')' | 'ADD' 'COLUMNS' '(' column (',' column)* ')' | 'ADD' table_constraint ('NOT' 'VALID')? | 'DROP' 'COLUMN'? present? id behaviour? | 'DROP' 'CONSTRAINT' present? id behaviour?
  | 'ALTER' 'COLUMN'? id column_change | 'RENAME' 'COLUMN'? id 'TO' id | 'RENAME' 'CONSTRAINT' id 'TO' id | 'RENAME' ('TO' | 'AS') path | 'SET' 'SCHEMA' id | 'SET' 'TABLESPACE' id | 'SET' ('LOGGED' | 'UNLOGGED') | ('SET' | 'RESET') '(' option_list ')' | 'SET' 'TBLPROPERTIES' '(' option_list ')' | 'OWNER' 'TO' account | ('VALIDATE' | 'ALTER') 'CONSTRAINT' id constraint_more*
  | ('ENABLE' | 'DISABLE') ('ALWAYS' | 'REPLICA')? (('TRIGGER' | 'RULE') (id | 'ALL') | 'ROW' 'LEVEL' 'SECURITY') | ('NO'? 'FORCE') 'ROW' 'LEVEL' 'SECURITY' | 'ATTACH' 'PARTITION' path ('DEFAULT' | 'FOR' 'VALUES' ('IN' '(' list ')' | 'FROM' '(' list ')' 'TO' '(' list ')')) | 'DETACH' 'PARTITION' path 'CONCURRENTLY'? | 'CLUSTER' 'ON' id | 'NO'? 'INHERIT' path | alteration_more ;
alteration_more: ('ADD' absent? | 'DROP' present?) ('PARTITION' '(' option_list ')')+ ;
placing: 'FIRST' | 'AFTER' id ;
column_change: 'SET' ('DEFAULT' expr | 'NOT' 'NULL' | 'STATISTICS' signed | 'STORAGE' id | 'GENERATED' ('ALWAYS' | 'BY' 'DEFAULT')) | 'DROP' ('DEFAULT' | 'NOT' 'NULL' | 'IDENTITY' present?) | ('SET' 'DATA')? 'TYPE' type ('COLLATE' path)? ('USING' expr)? | 'ADD' constraint | 'COMMENT' STR ;
drop: 'DROP' dropped 'CONCURRENTLY'? present? drop_name (',' drop_name)* ('ON' path)? behaviour? | 'DROP' 'OWNED' 'BY' accounts behaviour? ;
dropped: 'TEMPORARY'? 'TABLE' | 'MATERIALIZED'? 'VIEW' | 'INDEX' | 'SCHEMA' | 'DATABASE' | 'SEQUENCE' | 'TYPE' | 'DOMAIN' | 'FUNCTION' | 'PROCEDURE' | 'TRIGGER' | 'ROLE' | 'USER' | 'EXTENSION' | 'POLICY' | 'RULE' ;
drop_name: path ('(' (type (',' type)*)? ')')? | STR PARAM? ;
truncate: 'TRUNCATE' 'TABLE'? 'ONLY'? path (',' path)* (('RESTART' | 'CONTINUE') 'IDENTITY')? behaviour? ;
grant: 'GRANT' (privilege (',' privilege)*) ('ON' granted)? 'TO' accounts ('WITH' id 'OPTION')? | 'REVOKE' (('GRANT' | 'ADMIN') 'OPTION' 'FOR')? (privilege (',' privilege)*) ('ON' granted)? 'FROM' accounts behaviour? ;
privilege: ('ALL' 'PRIVILEGES'? | 'SELECT' | 'INSERT' | 'UPDATE' | 'DELETE' | 'CREATE' id? | 'ALTER' | 'DROP' | 'INDEX' | id id?) columns? ;
granted: ('TABLE' | 'SEQUENCE' | 'SCHEMA' | 'DATABASE' | 'FUNCTION' | 'PROCEDURE' | 'TYPE' | 'DOMAIN' | 'VIEW' | 'ALL' id 'IN' 'SCHEMA' | 'TABLES' | 'SEQUENCES' | 'FUNCTIONS')? (target_of (',' target_of)*)? ;
target_of: path ('(' (type (',' type)*)? ')')? | (id | '*') '.' '*' | '*' ;
transaction: 'BEGIN' begin_mode? ('WORK' | 'TRANSACTION')? transaction_modes? | 'START' 'TRANSACTION' transaction_modes? | ('COMMIT' | 'ROLLBACK' | 'END' | 'ABORT') ('WORK' | 'TRANSACTION')? ('TO' 'SAVEPOINT'? id)? ('AND' 'NO'? 'CHAIN')? | 'SAVEPOINT' id | 'RELEASE' 'SAVEPOINT'? id ;
begin_mode: 'DEFERRED' | 'IMMEDIATE' | 'EXCLUSIVE' ;
transaction_modes: transaction_mode (','? transaction_mode)* ;
transaction_mode: 'ISOLATION' 'LEVEL' ('SERIALIZABLE' | 'REPEATABLE' 'READ' | 'READ' ('COMMITTED' | 'UNCOMMITTED') | 'SNAPSHOT') | 'READ' ('ONLY' | 'WRITE') | 'NOT'? 'DEFERRABLE' ;
explain: ('EXPLAIN' | 'DESCRIBE' | 'DESC') ('ANALYZE' | 'VERBOSE' | 'EXTENDED' | 'FORMATTED' | 'QUERY' 'PLAN' | '(' option_list ')')* (query | insert | update | delete | merge | create | 'TABLE'? path) ;
session: 'SET' ('SESSION' | 'LOCAL' | 'GLOBAL')? assignment (',' assignment)* | 'SET' ('SESSION' | 'LOCAL')? ('TIME' 'ZONE' (expr | 'DEFAULT' | 'LOCAL') | 'TRANSACTION' transaction_modes | 'ROLE' (id | STR) | 'SCHEMA' STR | 'NAMES' (id | STR) | 'CONSTRAINTS' ('ALL' | path (',' path)*) ('DEFERRED' | 'IMMEDIATE')) | 'SET' 'SESSION' 'CHARACTERISTICS' 'AS' 'TRANSACTION' transaction_modes
  | 'RESET' ('ALL' | path) | 'SHOW' shown (('FROM' | 'IN') path)* ('LIKE' STR | 'WHERE' expr)? | 'USE' path | session_more ;
shown: 'ALL' | 'CREATE' ('TABLE' | 'VIEW' | 'DATABASE') path | 'FULL'? ('TABLES' | 'COLUMNS' | 'DATABASES' | 'SCHEMAS' | 'VIEWS' | 'FUNCTIONS') | 'TIME' 'ZONE' | ('INDEX' | 'GRANTS') ('FOR' account)? | path ;
session_more: 'DISCARD' ('ALL' | id) ;
assignment: (path | PARAM) ('=' | 'TO') (expr | 'ON' | 'DEFAULT') (',' (STR | path | NUM))* ;
maintenance: 'VACUUM' ('FULL' | 'FREEZE' | 'VERBOSE' | 'ANALYZE')* ('(' option_list ')')? (path columns?)? | 'ANALYZE' 'VERBOSE'? ('TABLE'? path columns? ('COMPUTE' 'STATISTICS' ('FOR' ('ALL'? 'COLUMNS')  (id (',' id)*)?)?)?)? | 'REINDEX' ('TABLE' | 'INDEX' | 'DATABASE' | 'SCHEMA')? 'CONCURRENTLY'? path? | 'CLUSTER' path? ('USING' id)?
  | 'COMMENT' 'ON' ('TABLE' | 'VIEW' | 'MATERIALIZED' 'VIEW' | 'CONSTRAINT' | 'COLUMN' | id) path call? ('ON' path)? 'IS' (STR | 'NULL') | 'LOCK' ('TABLE' | 'TABLES')? path (',' path)* ('IN' id+ 'MODE')? 'NOWAIT'?
  | 'COPY' (path columns? | '(' query ')') ('FROM' | 'TO') (STR | id | 'PROGRAM' STR) ('WITH'? '(' option_list ')' | 'WITH'? copy_word+)? | 'CALL' path call | 'EXECUTE' (path call? | STR) ('USING' list)? | 'PREPARE' id ('(' type (',' type)* ')')? ('AS' statement | 'FROM' (STR | PARAM)) | 'DEALLOCATE' 'PREPARE'? (id | 'ALL') | 'DO' ('LANGUAGE' id)? STR ('LANGUAGE' id)?
  | 'REFRESH' ('MATERIALIZED' 'VIEW' 'CONCURRENTLY'? path view_end? | 'TABLE' path) | ('LISTEN' | 'UNLISTEN' | 'NOTIFY') id (',' STR)? | 'DECLARE' id id* 'CURSOR' id* 'FOR' query | 'FETCH' id* NUM? ('FROM' | 'IN')? id | 'CLOSE' (id | 'ALL') | maintenance_more ;
copy_word: 'CSV' | 'HEADER' | 'BINARY' | ('DELIMITER' | 'NULL' | 'QUOTE' | 'ESCAPE' | 'ENCODING') 'AS'? STR ;
maintenance_more: 'CACHE' 'TABLE' path ('AS'? query)? | 'UNCACHE' 'TABLE' path ;
row: '(' (item (',' item)*)? ')' ;
item: expr | 'DEFAULT' ;
list: expr (',' expr)* ;
expr: operand (binary operand | postfix)* ;
binary: '+' | '-' | '*' | '/' | '%' | '||' | '=' | '<' | '>' | '<=' | '>=' | '<>' | '!=' | 'AND' | 'OR' | '->' | '->>' | '&' | '|' | '^' | '~' | '#' | 'NOT'? ('LIKE' | 'ILIKE' | 'SIMILAR' 'TO' | 'RLIKE') | '=>' | '@' '>' | '<' '@' | '!' '~' | '~' '*' | 'COLLATE' ;
postfix: 'IS' 'NOT'? ('NULL' | 'TRUE' | 'FALSE' | 'DISTINCT' 'FROM' operand | id) | 'NOT'? 'IN' ('(' (query | list)? ')' | path) | 'NOT'? 'BETWEEN' 'SYMMETRIC'? operand (plain operand)* 'AND' operand | 'ESCAPE' operand | '::' type | '[' expr? (':' expr?)? ']' | 'OVER' ('(' window ')' | id) | 'AT' 'TIME' 'ZONE' operand | '.' ('*' | id) ;
plain: '+' | '-' | '*' | '/' | '%' | '||' ;
window: id? ('PARTITION' 'BY' list)? order? (('ROWS' | 'RANGE' | 'GROUPS') (bound | 'BETWEEN' bound 'AND' bound) ('EXCLUDE' id id?)?)? ;
bound: 'UNBOUNDED' ('PRECEDING' | 'FOLLOWING') | 'CURRENT' 'ROW' | expr ('PRECEDING' | 'FOLLOWING') ;
operand: ('-' | '+' | '~' | 'NOT')* primary ;
primary: NUM | STR STR* | PARAM | ':' id | 'NULL' | 'TRUE' | 'FALSE' | 'DEFAULT' | path call? | '(' (query | list) ')' | 'CASE' expr? ('WHEN' expr 'THEN' expr)+ ('ELSE' expr)? 'END' | ('CAST' | 'TRY_CAST') '(' expr 'AS' type ')' | 'EXISTS' '(' query ')'
  | 'INTERVAL' (STR | signed | '(' expr ')') (id ('TO' id)?)? | ('LEFT' | 'RIGHT' | 'IF' | 'SET' | 'REPLACE' | 'VALUES') call | 'ARRAY' '[' list? ']' | ('ANY' | 'ALL' | 'SOME') '(' (query | list) ')' | 'ROW' row | id STR | '*' ;
call: '(' (('ALL' | 'DISTINCT')? argument (',' argument)* order? limits? | query)? ')' ('WITHIN' 'GROUP' '(' order ')')? ('FILTER' '(' 'WHERE' expr ')')? (('IGNORE' | 'RESPECT') 'NULLS')? ;
argument: '*' | expr ('AS' (id | type))? ('FROM' expr ('FOR' expr)?)? ('SEPARATOR' STR)? | ('LEADING' | 'TRAILING' | 'BOTH') expr? 'FROM' expr ;
type: path type_arguments? ('VARYING' | 'PRECISION' | 'UNSIGNED' | 'SIGNED' | 'LARGE' 'OBJECT')? type_arguments? (('WITH' | 'WITHOUT') 'LOCAL'? 'TIME' 'ZONE')? (('CHARACTER' 'SET' | 'CHARSET') id)? ('COLLATE' path)? ('[' NUM? ']' | 'ARRAY')* | 'SET' type_arguments | ('ARRAY' | 'MAP' | 'STRUCT') '<' (type | path ':'? type) (',' (type | path ':'? type))* ('>') | 'INTERVAL' (id ('TO' id)?)? ;
type_arguments: '(' (signed | STR | id) (',' (signed | STR | id))* ')' ;
path: id ('.' (id | word))* ;
"""

#: Rules that differ in the other dialects of SQL.
MYSQL = """
limits: 'LIMIT' expr (',' expr | 'OFFSET' expr)? ;
insert_mode: ('LOW_PRIORITY' | 'DELAYED' | 'HIGH_PRIORITY')? 'IGNORE'? ;
insert: with? ('INSERT' insert_mode 'INTO'? | 'REPLACE' 'INTO'?) path columns? (query | 'SET' settings | ('VALUE' row (',' row)*)) ('AS' id)? conflict? ;
conflict: 'ON' 'DUPLICATE' 'KEY' 'UPDATE' settings ;
update_end: order? limits? ;
update: with? 'UPDATE' 'IGNORE'? source (',' source)* 'SET' settings ('WHERE' expr)? update_end ;
delete: with? 'DELETE' ('FROM' path ('AS'? id)? ('USING' source)? | path (',' path)* 'FROM' source) ('WHERE' expr)? update_end ;
constraint_more: 'AUTO_INCREMENT' | 'KEY' | 'ON' 'UPDATE' initial | 'UNSIGNED' | 'ZEROFILL' | 'INVISIBLE' | 'VISIBLE' ;
table_constraint: ('CONSTRAINT' id?)? ('PRIMARY' 'KEY' ('USING' id)? key_parts | 'UNIQUE' ('KEY' | 'INDEX')? id? key_parts | 'FOREIGN' 'KEY' id? columns 'REFERENCES' path columns? reference* | 'CHECK' '(' expr ')' | ('FULLTEXT' | 'SPATIAL')? ('KEY' | 'INDEX') id? key_parts) ('USING' id | 'COMMENT' STR)* ;
table_option_more: 'DEFAULT'? ('ENGINE' | 'CHARSET' | 'COLLATE' | 'AUTO_INCREMENT' | 'ROW_FORMAT' | 'CHARACTER' 'SET') '='? (id | STR | NUM | 'DEFAULT') ;
alteration_more: 'DROP' ('PRIMARY' 'KEY' | ('INDEX' | 'KEY' | 'FOREIGN' 'KEY') id) | 'MODIFY' 'COLUMN'? column placing? | 'CHANGE' 'COLUMN'? id column placing? | ('DISABLE' | 'ENABLE') 'KEYS' | table_option_more ;
session_more: 'SHOW' ('WARNINGS' | 'ERRORS' | 'FULL'? 'PROCESSLIST' | ('GLOBAL' | 'SESSION')? ('VARIABLES' | 'STATUS') ('LIKE' STR)? | 'CREATE' 'DATABASE' path | 'KEYS' 'FROM' path) ;
maintenance_more: ('OPTIMIZE' | 'REPAIR' | 'CHECK' | 'ANALYZE') 'TABLE' path (',' path)* | 'UNLOCK' 'TABLES' | 'LOCK' 'TABLES' path id (',' path id)* | 'LOAD' 'DATA' 'LOCAL'? 'INFILE' STR 'INTO' 'TABLE' path ('FIELDS' 'TERMINATED' 'BY' STR)? ('IGNORE' NUM 'LINES')? columns? | 'FLUSH' (id | 'PRIVILEGES' | 'TABLES') ;
"""
SQLITE = """
limits: 'LIMIT' expr (',' expr | 'OFFSET' expr)? ;
insert_mode: ('OR' ('REPLACE' | 'IGNORE' | 'ABORT' | 'FAIL' | 'ROLLBACK'))? ;
insert: with? ('INSERT' insert_mode | 'REPLACE') 'INTO' path ('AS' id)? columns? (query | 'DEFAULT' 'VALUES') conflict* returning? ;
update: with? 'UPDATE' insert_mode path ('AS'? id)? 'SET' settings ('FROM' source (',' source)*)? ('WHERE' expr)? returning? ;
constraint_more: 'AUTOINCREMENT' | 'NOT'? 'DEFERRABLE' | 'INITIALLY' id | 'ON' 'CONFLICT' ('REPLACE' | 'IGNORE' | 'ABORT' | 'FAIL' | 'ROLLBACK') ;
created: ('TEMP' | 'TEMPORARY')? 'TABLE' absent? path table_body | ('TEMP' | 'TEMPORARY')? 'VIEW' absent? path columns? 'AS' query | 'UNIQUE'? 'INDEX' absent? path 'ON' path '(' key_part (',' key_part)* ')' ('WHERE' expr)? | 'VIRTUAL' 'TABLE' absent? path 'USING' id ('(' (module_part (',' module_part)*)? ')')?
  | ('TEMP' | 'TEMPORARY')? 'TRIGGER' absent? path ('BEFORE' | 'AFTER' | 'INSTEAD' 'OF')? event 'ON' path ('FOR' 'EACH' 'ROW')? ('WHEN' expr)? block ;
module_part: expr id* | STR ;
table_option_more: ','? ('WITHOUT' 'ROWID' | 'STRICT') ;
session_more: 'PRAGMA' path ('=' (expr | 'ON' | 'DELETE' | 'DEFAULT' | 'FULL') | '(' (expr | 'FULL') ')')? ;
maintenance_more: 'ATTACH' 'DATABASE'? expr 'AS' (id | STR) | 'DETACH' 'DATABASE'? id | 'VACUUM' id? ('INTO' expr)? ;
"""
TRANSACT = """
file: (batch? (';' | 'GO' NUM?))* batch? ;
batch: statement | 'DECLARE' declared (',' declared)* | 'SET' PARAM ('=' | '+' '=') expr | 'SET' id id? 'ON' | 'SET' id path ('ON' | id) | 'PRINT' expr | ('EXEC' | 'EXECUTE') (PARAM '=')? path (expr (',' expr)*)? | 'IF' expr batch ';'? ('ELSE' batch)? | 'WHILE' expr batch | 'BEGIN' ('TRY' | 'CATCH')? (batch? ';')* 'END' ('TRY' | 'CATCH')? | 'THROW' | 'RETURN' expr? ;
declared: PARAM 'AS'? (type ('=' expr)? | 'TABLE' '(' element (',' element)* ')') ;
quantity: ('ALL' | 'DISTINCT')? ('TOP' (NUM | PARAM | '(' expr ')') 'PERCENT'? ('WITH' 'TIES')?)? ;
table: (path call? | PARAM | '#' '#'? id | '(' query ')' | '(' source ')') ('AS'? id columns?)? ('WITH' '(' id (',' id)* ')')? ;
join: ('INNER' | ('LEFT' | 'RIGHT' | 'FULL') 'OUTER'? | 'CROSS')? 'JOIN' table ('ON' expr)? | ('CROSS' | 'OUTER') 'APPLY' table ;
or_replace: 'OR' 'ALTER' ;
created: 'TABLE' (path | '#' '#'? id) '(' element (',' element)* ')' table_option_more* | 'VIEW' path columns? 'AS' query | 'UNIQUE'? ('CLUSTERED' | 'NONCLUSTERED')? 'INDEX' id 'ON' path '(' key_part (',' key_part)* ')' index_option* | 'SCHEMA' id | 'DATABASE' id
  | ('PROCEDURE' | 'PROC') path ('(' parameter_of (',' parameter_of)* ')' | parameter_of (',' parameter_of)*)? 'AS' batch | 'FUNCTION' path '(' (parameter_of (',' parameter_of)*)? ')' 'RETURNS' (type | 'TABLE') 'AS' ('RETURN' expr | batch) | 'TRIGGER' path 'ON' path ('AFTER' | 'INSTEAD' 'OF' | 'FOR') event (',' event)* 'AS' batch ;
parameter_of: PARAM 'AS'? type ('=' expr)? ('OUTPUT' | 'OUT' | 'READONLY')? ;
constraint_more: 'IDENTITY' ('(' signed ',' signed ')')? | 'CLUSTERED' | 'NONCLUSTERED' ;
table_constraint_more: ('PRIMARY' 'KEY' | 'UNIQUE') ('CLUSTERED' | 'NONCLUSTERED') key_parts ;
table_option_more: 'ON' path ;
limits: 'OFFSET' expr ('ROW' | 'ROWS') ('FETCH' ('FIRST' | 'NEXT') expr ('ROW' | 'ROWS') 'ONLY')? ;
"""

SHELL = """
file: breaks? list? ;
list: andor (separator andor)* separator? ;
separator: (';' | '&') NL* | NL+ ;
breaks: NL+ ;
andor: pipe (('&&' | '||') NL* pipe)* ;
pipe: ('!' | 'time')* command (('|' | '|&') NL* command)* ;
command: simple | compound redirect* | definition ;
simple: (redirect)* WORD (argument | redirect)* | redirect+ ;
redirect: REDIR argument ;
argument: WORD | 'if' | 'then' | 'else' | 'elif' | 'fi' | 'for' | 'while' | 'until' | 'do' | 'done' | 'case' | 'esac' | 'in' | 'function' | 'select' | '{' | '}' | '!' | 'time' ;
compound: 'if' body 'then' body ('elif' body 'then' body)* ('else' body)? 'fi' | ('while' | 'until') body 'do' body 'done'
  | ('for' | 'select') name loop | '{' body '}' | '(' body ')' | 'case' argument NL* 'in' NL* arm* last? 'esac' ;
loop: NL* ('in' argument* (';' | NL) NL* | ';' NL*)? ('do' body 'done' | '{' body '}') ;
name: WORD | 'in' | 'time' ;
body: NL* list ;
arm: '('? argument ('|' argument)* ')' NL* list? (';;' | ';&' | ';;&') NL* ;
last: '('? argument ('|' argument)* ')' NL* list? ;
definition: WORD '(' ')' NL* compound redirect* | 'function' WORD ('(' ')')? NL* compound redirect* ;
"""

#: A file that declares a module.
JAVA_MODULE = """
file: import* annotation* 'open'? 'module' dotted '{' directive* '}' ;
directive: 'requires' ('transitive' | 'static')* dotted ';' | ('exports' | 'opens') dotted ('to' dotted (',' dotted)*)? ';' | 'uses' dotted ';' | 'provides' dotted 'with' dotted (',' dotted)* ';' ;
"""

#: Rules of JavaScript that differ in modules, which are strict.
MODULE = """
ident: ID | %(soft)s ;
statement: block | variables EOS | named_function | named_class %(declarations)s | 'if' '(' expr ')' statement ('else' statement)? | 'for' 'await'? '(' for_head ')' statement
  | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' EOS | 'return' expr? EOS | 'throw' expr EOS | ('break' | 'continue') ident? EOS | 'debugger' EOS
  | 'try' block ('catch' ('(' pattern annotation ')')? block)? ('finally' block)? | 'switch' '(' expr ')' '{' clause* '}' | ';' | ident ':' statement | first EOS ;
"""
#: Words that modules reserve besides those that every script does.
_STRICT = {"let", "static", "await", "yield", "implements", "private", "public", "protected", "interface"}

_ROUND = [("(", ")"), ("[", "]")]
_CURLY = [*_ROUND, ("{", "}")]
_TEMPLATES = [*_CURLY, ("${", "}$"), ("`start", "`end")]


def _statements(g: Grammar, words, parts, fresh, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Where the statements of a block of Python begin and end."""
    kind = g.token_of
    newline, indent, at_sign = kind["NEWLINE"], kind["INDENT"], kind["@"]
    going_on = {kind[k] for k in ("else", "elif", "except", "finally") if k in kind}
    first, line = begin, begin
    for i in range(begin, end):
        if words[i] == newline:
            following = words[i + 1] if i + 1 < end else -1
            if following == indent and parts[i + 1] or words[line] == at_sign:
                line = i + 1
                continue
        elif words[i] != indent:
            continue
        line = i + 1
        if i + 1 < end and words[i + 1] in going_on:
            continue
        yield first, i + 1
        first = i + 1
    if first < end:
        yield first, end


#: Tokens that go on with what stands before them, even at the beginning of a line.
_GOING_ON = ("else", "catch", "finally", "while", "from", "as", "of", "in", "instanceof", ".", "?.", ",", ";", ")", "]", "}", "(", "[", "?", ":", "=", "=>", "->", "+", "-", "*", "/", "%", "&&", "||", "??", "<", ">", "|", "&", "`start")


def _lines(g: Grammar, words, parts, fresh, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Where the statements or members of a block of script or Java probably begin and end."""
    kind = g.token_of
    semicolon, brace = kind[";"], kind["{"]
    going_on = {kind[k] for k in _GOING_ON if k in kind}
    first = begin
    for i in range(begin + 1, end):
        before = words[i - 1]
        if (before == semicolon or before == brace and parts[i - 1]) and (fresh is None or fresh[i]) and words[i] not in going_on:
            yield first, i
            first = i
    if first < end:
        yield first, end


def _listing(rules: Rules, items: tuple[str, ...]) -> dict[str, str]:
    """The lists of these items: start symbols, and rules that enclose one."""
    out = {}
    for name, rows in rules.items():
        for row in rows:
            many = [p for p in row if p in rules and p[0] == "&" and p.partition("~")[0][-1] == "*" and rules[p][0][0].partition("~")[0] in items]
            if len(rows) == 1 and len(many) == 1 and (row == many and name.partition("~")[0] == "file" or len(row) == 3 and row[1] == many[0] and row[0] == "'{"):
                out[name] = many[0]
    return out


def _quoted(words: Iterable[str]) -> str:
    return " | ".join(f"'{w}'" for w in sorted(words))


def _script(parts: dict[str, str], rules: str, strict: bool) -> Rules:
    soft = lexers.JS_SOFT - (_STRICT if strict else set())
    values = parts | {"soft": _quoted(soft), "words": _quoted(lexers.JS_KEYS | lexers.JS_SOFT)}
    return read_rules(SCRIPT % values) | read_rules(rules) | (read_rules(MODULE % values) if strict else {})


def _scripts(parts: dict[str, str], rules: str) -> dict[str, Rules]:
    loose = _script(parts, rules, False)
    # Only a module imports and exports.
    loose["file"] = read_rules("file: statement* ;")["file"] if parts is _JS_PARTS else loose["file"]
    return {"module": _script(parts, rules, True), "script": loose} if parts is _JS_PARTS else {"typescript": loose}


_SQL_TEXTS = (SQL, MYSQL, SQLITE, TRANSACT)
#: Every word of SQL that the grammars name.
SQL_WORDS = frozenset(w for text in _SQL_TEXTS for w in re.findall(r"'([A-Z][A-Z_]*)'", text))


def _sql() -> dict[str, Rules]:
    words = f"word: {_quoted(lexers.SQL_RESERVED)} ; id: ID | {_quoted(SQL_WORDS - lexers.SQL_RESERVED)} ;"
    base = read_rules(SQL) | read_rules(words)
    return {"standard": base, "mysql": base | read_rules(MYSQL), "sqlite": base | read_rules(SQLITE), "transact": base | read_rules(TRANSACT)}


#: Language: its lexer. A text is invalid if the lexer or every dialect of the grammar rejects it.
LANGUAGES = {
    "json": lexers.json_tokens,
    "toml": lexers.toml_tokens,
    "yaml": lexers.yaml_tokens,
    "python": lexers.python_tokens,
    "javascript": lexers.script_tokens,
    "typescript": lexers.script_tokens,
    "java": lexers.java_tokens,
    "sql": partial(lexers.sql_tokens, words=SQL_WORDS),
    "shell": lexers.shell_tokens,
}


def lexer(language: str, more: Iterable[str] = ()) -> Callable[[str], lexers.Tokens]:
    if language == "python" and "python2" in more:
        return partial(lexers.python_tokens, soft=lexers.PY_SOFT | {"print", "exec"})
    return LANGUAGES[language]


def dialects(language: str, more: Iterable[str] = ()) -> dict[str, Rules]:
    """The grammars of a language's dialects; those in ``more`` only on request."""
    if language == "javascript":
        return _scripts(_JS_PARTS, _JS_RULES)
    if language == "typescript":
        return _scripts(_TS_PARTS, _TS_RULES)
    if language == "sql":
        return _sql()
    if language == "java":
        unit = read_rules(JAVA)
        return {"unit": unit, "module": unit | read_rules(JAVA_MODULE)}
    if language == "python":
        modern = read_rules(PYTHON)
        if "python2" not in more:
            return {"python3": modern}
        return {"python3": modern | {"id": [*modern["id"], ["'print"], ["'exec"]]}, "python2": modern | read_rules(PYTHON_2)}
    if language == "json":
        return {"json": read_rules(JSON)} | ({"lines": read_rules(JSON) | read_rules("file: value+ ;")} if "jsonlines" in more else {})
    return {language: read_rules({"toml": TOML, "yaml": YAML, "shell": SHELL}[language])}


@lru_cache(maxsize=None)
def grammar(language: str, more: tuple[str, ...] = ()) -> Grammar:
    """The grammar of all dialects of a language, run together."""
    found = dialects(language, more)
    rules = together(found) if len(found) > 1 else next(iter(found.values()))
    if language == "python":
        lines = {n: n.replace("suite_block", "statement") for n in rules if n.partition("~")[0] == "suite_block"}
        lines |= {n: n.replace("file", "statement") for n in rules if n.partition("~")[0] == "file" and (n != "file" or len(found) == 1)}
        lines = {n: s if s in rules else "statement" for n, s in lines.items()}
        return Grammar(rules, "file", [*_CURLY, ("INDENT", "DEDENT")], lines, _statements, exact=True)
    if language in ("javascript", "typescript", "java"):
        return Grammar(rules, "file", _CURLY if language == "java" else _TEMPLATES, _listing(rules, ("statement", "item", "member", "typed")), _lines)
    brackets = {"sql": _ROUND, "json": _CURLY, "toml": _CURLY[1:], "yaml": _CURLY[1:]}.get(language, ())
    return Grammar(rules, "file", brackets)

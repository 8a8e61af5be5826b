"""The grammars of the registered queries."""

SESSION = """
START -> Visit | START Visit
Visit -> view | view Acts | signup | click | error Recover
Acts -> click | click Acts | click purchase
Recover -> click | view
"""
FUNNEL = """
START -> Entry Exit | Entry Middle Exit
Entry -> view | signup
Middle -> click | click click | view click | click Middle error
Exit -> purchase | error | click purchase
"""
FLAGS = """
START -> Item | START Item
Item -> AO | RO | NF | AF Pair NO | RF
Pair -> AF | RF | Pair Pair
"""
TALK = """
START -> Turns | system Turns
Turns -> user | user assistant | user assistant Turns
"""
EXPRESSIONS = """
START -> E
E -> E + E | E * E | ( E ) | x | 1
"""
LINES = """
START -> Statement NEWLINE
Statement -> NAME = Value | return Value | Value
Value -> NAME | NUMBER | STRING | Call | Value + Value | Value - Value | ( Value )
Call -> NAME ( ) | NAME ( Arguments )
Arguments -> Value | Value , Arguments
"""
#: The worked example of the notation.
IF = """
 S -> X
 X -> I | F | P
 P -> I O I
 F -> IF | BF
IF -> if B then I else I
BF -> if B then B else B
 O -> + | - | * | /
 I -> 1 | 2 | 3 | 4 | IF
 N -> !
 B -> true | false | B BO B | ( B ) | BF | N B
BO -> and | or
"""
GRAMMARS = {"session": SESSION, "funnel": FUNNEL, "flags": FLAGS, "talk": TALK, "expressions": EXPRESSIONS}

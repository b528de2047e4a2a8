"""Training-data operators: text in, decisions out.

Every module holds one operator with its own general interface; ``queries``
wires them to the tables of a scale-factor directory.  Nothing outside this
subpackage imports it.
"""

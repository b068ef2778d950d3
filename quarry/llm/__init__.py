"""Operators for preparing training text, and the queries that apply them.

Nothing else in the package imports this subpackage, so it can be removed
whole.  Each module holds one operator with its own general interface;
``queries`` applies the operators to the given tables.

Functions that run in tasks are sent by value, so executors need not have this
package installed, nor on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

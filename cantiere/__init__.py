"""Cantiere: public-works and procurement analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function.  Rule tables, weights and thresholds are plain data, see
:mod:`cantiere.functions.presets`.
"""

__version__ = "0.1.0"

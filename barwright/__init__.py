"""Barwright: a Spark-first toolkit for researching rule-based trading strategies.

Sub-packages: ``sources`` (readers, writers, exporters), ``operators`` (cleaning,
signals, risk, the portfolio fold, search and robustness analysis), ``functions``
(column expressions and aggregates), ``plans`` (registered queries with their SQL
oracles) and ``streaming`` (watermarked bars and the stateful fold).
"""

"""Clearance-market analytics expressed as Spark jobs.

Sub-packages
------------
functions   column expressions (text normalisation, document mining, reply parsing)
plans       term lists compiled into clause tables
operators   DataFrame -> DataFrame jobs (matching, graph, store, market, registry)
sources     scans with explicit schemas and the tabular export
streaming   incremental refresh of the corpus
"""

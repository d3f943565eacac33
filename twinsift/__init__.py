"""twinsift: duplicate and near-duplicate analytics expressed as Spark plans.

Subpackages
-----------
``functions``   column expressions (bits, hashes, media rules, paths)
``sources``     readers, schemas, file listings, manifests
``operators``   DataFrame-to-DataFrame operators (joins, grouping, clustering, selection)
``plans``       storage helpers, generations and the registered queries
``streaming``   outbox and log-feed streams
"""

"""tidelog: collection-intelligence operators on PySpark.

Every operator takes DataFrames and returns a DataFrame.  Packages:

* ``functions`` - Column builders (predicates, identifiers, hosts, key fingerprints, ordering helpers)
* ``operators`` - table-to-table operators
* ``sources``   - readers and writers
* ``streaming`` - Structured Streaming forms of the timeline, extraction and alerting
* ``plans``     - the registered queries over the driver tables, each with its SQL twin
"""

__version__ = "0.1.0"

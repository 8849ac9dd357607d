"""echotrace — text-reuse and corpus processing as Spark DataFrame plans.

Sub-packages:

* ``functions``  Column -> Column text functions (cleaning, segmentation, tokens)
* ``sources``    readers and sinks (posts, reference lists, corpora, dictionaries)
* ``operators``  DataFrame -> DataFrame operators (filters, retrieval, scoring,
                 HTML extraction, token/tag tables)
* ``plans``      end-to-end jobs (post cleaning, article matching) and fixture views
* ``streaming``  the stateless cleaning plan on a ``readStream`` source
"""

__version__ = "0.1.0"

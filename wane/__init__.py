"""wane: find and evaluate uses of deprecated Python APIs with Spark.

The stages are DataFrame operators: declaration evidence -> catalog, client
snippets -> call statuses, candidates -> verdicts, verdicts -> metrics.
"""

import sys

from pyspark import cloudpickle

# the few Python helpers travel with the job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

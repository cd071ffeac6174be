"""lumen: model-evaluation analytics as Spark DataFrame operators.

Entry points by task:

* text, prompts, verdicts ........ ``lumen.functions.text``, ``lumen.functions.verdict``
* paths, labels, vectors ......... ``lumen.functions.paths``, ``.labels``, ``.vectors``
* filters and studies ............ ``lumen.operators.filters``
* F1 / policies / exact AUC ...... ``lumen.operators.metrics``
* best-key join .................. ``lumen.operators.joins``
* sampling plans and draws ....... ``lumen.operators.sampling``
* probes (train, score, evaluate)  ``lumen.operators.probes``, ``lumen.operators.results``
* set-overlap F1 ................. ``lumen.operators.setf1``
* model calls over Arrow batches . ``lumen.operators.inference``
* sources / sinks / streaming .... ``lumen.sources.tables``, ``lumen.sinks.writers``, ``lumen.streaming.incremental``
* session settings ............... ``lumen.session.build_session``
"""

__version__ = "0.1.0"

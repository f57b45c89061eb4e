"""hydrolens: Spark-native operators for environmental field-sample analytics.

Five jobs, each a set of ``DataFrame -> DataFrame`` functions:

1. reshape and clean field measurements        (``operators.clean``, ``operators.reshape``)
2. profile them                                 (``operators.profile``)
3. enrich samples with the best satellite scene (``operators.scenes``, ``functions.spectral``)
4. train and compare regressors per target      (``operators.learn``)
5. validate models against spectral indices     (``plans.validate``)
"""

__version__ = "0.1.0"

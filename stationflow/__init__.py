"""Historical station-demand analytics as plain DataFrame-to-DataFrame functions on Spark."""

"""tierdown: data retention as Spark jobs.

Select what is older than a policy allows, copy it to every destination, bundle
it by calendar bucket, prune only what was safely copied, restore it, and report
each run as rows.
"""

__version__ = "0.1.0"

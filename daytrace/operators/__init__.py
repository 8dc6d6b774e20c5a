"""DataFrame-to-DataFrame jobs.

Size note used throughout: after `days.collapse_duplicates` a well has at most one row per
calendar date, so a window or group keyed by well holds at most some 36,500 rows per century
whatever the size of the input. Raw rows carry no such bound and are only ever grouped with
partial aggregation.
"""

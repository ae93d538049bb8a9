"""No streaming operators: the workload is batch only, every input is a finished file.

All operators are DataFrame-to-DataFrame functions, so a streaming job can call
the row-local ones (cleaning, derived columns, bands) as they are.
"""

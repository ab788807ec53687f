"""Commands as functions from DataFrame to DataFrame.  Row order is the column `__fid`."""

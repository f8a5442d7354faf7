"""bitloom: coded-video and table analytics on PySpark DataFrames."""

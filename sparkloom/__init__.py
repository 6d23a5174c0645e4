"""sparkloom: set-, rank- and text-analytics operators as PySpark DataFrame programs."""

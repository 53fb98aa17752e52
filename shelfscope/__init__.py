"""shelfscope: retail price intelligence as Spark DataFrame operators."""

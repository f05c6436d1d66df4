from tallyspark.cli import run

run()
